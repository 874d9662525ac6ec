"""The same results in DuckDB's SQL, for checking."""

# The whitespace class of `functions.text`, in this engine's notation.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{WS}'), lambda w: w <> '')"


def lexical(query: str, document: str) -> str:
    asked = f"list_distinct({words(query)})"
    found = f"list_intersect({asked}, list_distinct({words(document)}))"
    return f"CASE WHEN len({asked}) = 0 THEN 0.0::DOUBLE ELSE len({found}) / len({asked})::DOUBLE END"


def snippet(text: str) -> str:
    line = f"trim(regexp_replace({text}, '{WS}', ' ', 'g'))"
    return f"CASE WHEN length({line}) <= 280 THEN {line} ELSE rtrim(substring({line}, 1, 279)) || '…' END"


def chunk_ctes(files: str, name: str = "chunks", extra: str = "") -> str:
    """CTE of chunks with metadata; `files` selects filename, content and the extra columns."""
    return f"""{name} AS (
  SELECT filename || '_' || i AS key, filename, 'api_upload/' || filename AS source_path,
         regexp_replace(filename, '\\.[^.]*$', '') AS title, '.md' AS doc_type,
         CAST(i AS INTEGER) AS chunk_index, substring(content, i * 1300 + 1, 1500) AS chunk_text{extra}
  FROM (SELECT *, unnest(range(CASE WHEN length(content) = 0 THEN 0 WHEN length(content) <= 1500 THEN 1
                         ELSE 1 + CAST(ceil((length(content) - 1500) / 1300.0) AS BIGINT) END)) AS i
        FROM ({files})))"""


DOCS = "SELECT 'doc_' || doc_id || '.md' AS filename, text AS content, lang FROM documents"
CHUNKS = chunk_ctes(DOCS)
LANGUAGE_CHUNKS = chunk_ctes(DOCS, extra=", lang").replace("'api_upload/' || filename AS source_path", "lang AS source_path")

QUESTIONS = "SELECT item_id AS query_id, text AS query FROM benchmark"
LAST_TURNS = """SELECT conv_id || '#' || max(turn) AS query_id, arg_max(text, turn) AS query
FROM conversations WHERE role = 'user' GROUP BY conv_id"""
USER_TURNS = "SELECT conv_id || '#' || turn AS query_id, text AS query FROM conversations WHERE role = 'user'"


def hashed(name: str, id_col: str, text: str, source: str) -> str:
    """CTEs {name} (id, b, w): the non-zero float32 components of hashed text vectors, and
    {name}_norm (id, n)."""
    return f"""{name}_counts AS (
  SELECT id, CAST('0x' || substring(md5(word), 1, 8) AS BIGINT) % 64 AS b, CAST(count(*) AS DOUBLE) AS c
  FROM (SELECT {id_col} AS id, unnest({words(text)}) AS word FROM {source}) GROUP BY ALL),
{name} AS (SELECT id, b, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT) AS w FROM {name}_counts),
{name}_norm AS (SELECT id, sqrt(sum(w::DOUBLE * w::DOUBLE)) AS n FROM {name} GROUP BY id)"""


def ranked_ctes(queries: str, chunks: str, max_distance: float | None = None) -> str:
    """CTEs up to `marked`: reranked hits with the flags of the diversity cap."""
    near = f"AND distance <= {max_distance}" if max_distance is not None else ""
    return f"""q AS ({queries}),
{chunks},
{hashed("qv", "query_id", "query", "q")},
{hashed("cv", "key", "chunk_text", "chunks")},
dots AS (SELECT qv.id AS query_id, cv.id AS key, sum(qv.w::DOUBLE * cv.w::DOUBLE) AS dot
         FROM qv JOIN cv USING (b) GROUP BY ALL),
near AS (
  SELECT qn.id AS query_id, cn.id AS key, round(1 - coalesce(dot, 0) / (qn.n * cn.n), 6) + 0.0::DOUBLE AS distance
  FROM qv_norm qn CROSS JOIN cv_norm cn LEFT JOIN dots ON dots.query_id = qn.id AND dots.key = cn.id),
hits AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS INTEGER) AS raw_rank
                 FROM near) WHERE raw_rank <= 12 {near}),
scored AS (
  SELECT hits.*, q.query, c.title, c.source_path, c.doc_type, c.chunk_index, c.chunk_text,
         {lexical("q.query", "c.chunk_text")} AS lexical,
         coalesce(nullif(c.source_path, ''), nullif(c.title, ''), 'unknown') AS doc_key
  FROM hits JOIN q USING (query_id) JOIN chunks c USING (key)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw_rank) AS INTEGER) AS score_rank
  FROM (SELECT *, (1.0::DOUBLE - CASE WHEN distance = 0 THEN 1.0::DOUBLE ELSE distance END)
               + lexical * 0.5::DOUBLE AS score FROM scored)),
allowed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_key ORDER BY score_rank) AS doc_rank FROM ranked),
marked AS (
  SELECT *, sum(CASE WHEN doc_rank <= 2 THEN 1 ELSE 0 END)
            OVER (PARTITION BY query_id ORDER BY score_rank ROWS UNBOUNDED PRECEDING) AS taken FROM allowed),
sources AS (
  SELECT query_id, CAST(taken AS INTEGER) AS rank, key AS id, title, source_path,
         {snippet("chunk_text")} AS snippet, doc_type, chunk_index, distance, score_rank, doc_key, chunk_text
  FROM marked WHERE doc_rank <= 2 AND taken <= 4)"""


RANKED = "WITH " + ranked_ctes(QUESTIONS, LANGUAGE_CHUNKS)
RETRIEVED = "WITH " + ranked_ctes(QUESTIONS, CHUNKS)
FIRST_CHUNKS = f"""{chunk_ctes(DOCS, "every")},
chunks AS (SELECT * FROM every WHERE source_path BETWEEN 'api_upload/doc_1' AND 'api_upload/doc_5' AND chunk_index = 0
           AND NOT title < 'doc_2')"""
FILTERED = "WITH " + ranked_ctes(QUESTIONS, FIRST_CHUNKS)
SOURCE_COLUMNS = "query_id, rank, id, title, source_path, snippet, doc_type, chunk_index, distance"

HEADING = "'[S' || rank || '] ' || coalesce(nullif(title, ''), nullif(source_path, ''), id)"
BLOCK = f"""'## Sources' || chr(10) || 'Cite them.' || chr(10) || string_agg({HEADING} || chr(10)
  || CASE WHEN source_path <> '' THEN 'Path: ' || source_path || chr(10) ELSE '' END || snippet, chr(10) ORDER BY rank)"""

MESSAGES = "SELECT conv_id AS session_id, CAST(turn AS INTEGER) AS seq, role, text AS content FROM conversations"

TURNS = """turns AS (
  SELECT u.conv_id || '#' || u.turn AS turn_id, u.conv_id AS session_id, u.turn, u.text AS message, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def history(n: int, where: str = "WHERE role = 'user'") -> str:
    return f"""SELECT session_id, seq, CAST(len(h) AS INTEGER) AS n, array_to_string(h, '|') AS history FROM (
  SELECT *, coalesce(list(role || '=' || content) OVER (
    PARTITION BY session_id ORDER BY seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), []) AS h
  FROM ({MESSAGES})) {where}"""


CONTEXT = f"""SELECT session_id, seq, content, array_to_string(h, '') AS context FROM (
  SELECT *, coalesce(list(role || ': ' || content || chr(10)) OVER (
    PARTITION BY session_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS h
  FROM ({MESSAGES})) WHERE role = 'user'"""


def knn(distance: str, k: int, tail: str = "") -> str:
    return f"""SELECT query_id, CAST(raw_rank AS INTEGER) AS raw_rank, key, distance{tail} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS raw_rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS key, v.label,
           round({distance}(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0::DOUBLE AS distance
    FROM embeddings q CROSS JOIN embeddings v)) WHERE raw_rank <= {k}"""


COSINE = knn("list_cosine_distance", 12)
EUCLIDEAN = knn("list_distance", 12)

INCOMING = """SELECT 'doc_' || doc_id || '.md' AS filename, translate(text, 'aeiou', '') AS content
    FROM documents JOIN labels USING (doc_id) WHERE quality = 1
    UNION ALL SELECT 'item_' || item_id || '.md', text FROM benchmark"""


def upserted(match: str) -> str:
    return f"""WITH {chunk_ctes(DOCS, "old")}, {chunk_ctes(INCOMING, "new")}
SELECT key, chunk_index, version, md5(chunk_text) AS text_md5 FROM (
  SELECT key, chunk_index, 1::BIGINT AS version, chunk_text FROM old WHERE {match} NOT IN (SELECT {match} FROM new)
  UNION ALL SELECT key, chunk_index, 2::BIGINT, chunk_text FROM new)"""


ORACLE = {
    "src_markdown": """
SELECT 'doc_' || doc_id || '.md' AS filename, 'document' AS outcome, md5(text) AS content_md5 FROM documents
UNION ALL SELECT 'page_' || page_id || '.html', 'not a .md file', NULL FROM pages
UNION ALL SELECT 'item_' || item_id || '.MD', 'not a .md file', NULL FROM benchmark""",
    "markdown_folder": """
SELECT 'kb/' || lang || '/doc_' || doc_id || '.md' AS filename, 'document' AS outcome,
       md5(CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END) AS content_md5 FROM documents
UNION ALL SELECT 'web/page_' || page_id || '.html', 'not a .md file', NULL FROM pages
UNION ALL SELECT 'item_' || item_id || '.MD', 'not a .md file', NULL FROM benchmark""",
    "stream_outcomes": f"""WITH {CHUNKS}
SELECT 'doc_' || doc_id || '.md' AS filename, count(key) AS chunks_indexed, 'success' AS status, doc_id % 2 = 0 AS searchable
FROM documents LEFT JOIN chunks ON chunks.filename = 'doc_' || doc_id || '.md' GROUP BY doc_id""",
    "chunk_metadata": f"""WITH {CHUNKS}
SELECT key, filename, source_path, title, doc_type, chunk_index, CAST(length(chunk_text) AS INTEGER) AS n_chars FROM chunks""",
    "ingest_report": f"""WITH {CHUNKS}
SELECT d.filename, count(c.key) AS chunks_indexed, 'success' AS status
FROM ({DOCS}) d LEFT JOIN chunks c USING (filename) GROUP BY d.filename""",
    "vector_upsert": upserted("key"),
    "vector_upsert_replace": upserted("filename"),
    "vector_upsert_log": upserted("key"),
    "vector_upsert_log_replace": upserted("filename"),
    "vector_scan": f"""WITH {CHUNKS}
SELECT key, filename, source_path, title, doc_type, chunk_index, 1::BIGINT AS version,
       CAST(length(chunk_text) AS INTEGER) AS n_chars,
       CAST(CASE WHEN len({words("chunk_text")}) > 0 THEN 64 ELSE 0 END AS INTEGER) AS dim FROM chunks""",
    "transcript_scan": f"""
SELECT d.doc_id AS session_id, m.seq, m.role, m.content FROM documents d LEFT JOIN ({MESSAGES}) m ON m.session_id = d.doc_id""",
    "transcript_sink": MESSAGES,
    "transcript_files": MESSAGES,
    "transcript_log": MESSAGES,
    "chunk_text": f"WITH {CHUNKS} SELECT filename, chunk_index, chunk_text FROM chunks",
    "embed": f"""WITH {CHUNKS}, {hashed("cv", "key", "chunk_text", "chunks")}
SELECT id AS key, CAST(b AS INTEGER) AS bucket, round(w::DOUBLE, 6) AS weight FROM cv""",
    "pool_first_vector": """
SELECT vec_id, shape, CAST(pos AS INTEGER) AS pos, round(embedding[pos + 1]::DOUBLE, 6) AS value
FROM embeddings, (SELECT unnest(['three', 'two', 'flat']) AS shape), (SELECT unnest(range(64)) AS pos)""",
    "vector_cast_check": """
SELECT vec_id, CASE label WHEN 0 THEN 'missing vector' WHEN 1 THEN 'dimension 65' ELSE 'ok' END AS outcome FROM embeddings""",
    "knn_cosine": COSINE,
    "knn_cosine_cells": COSINE,
    "knn_euclidean": EUCLIDEAN,
    "knn_euclidean_cells": EUCLIDEAN,
    "distance_cutoff": f"SELECT * FROM ({knn('list_cosine_distance', 12, ', label')}) WHERE distance <= 0.5",
    "search_gate": """
SELECT vec_id AS query_id, CASE WHEN label IN (0, 1) THEN 0::BIGINT ELSE (SELECT least(3, count(*)) FROM embeddings) END AS n_hits
FROM embeddings""",
    "tokenize_ws": f"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(list_sort(t), ' ') AS tokens
FROM (SELECT doc_id, list_distinct({words("text")}) AS t FROM documents)""",
    "lexical_overlap": f"""
SELECT a.session_id, a.seq, round({lexical("a.content", "b.content")}, 6) AS lexical
FROM ({MESSAGES}) a JOIN ({MESSAGES}) b ON b.session_id = a.session_id AND b.seq = a.seq + 1""",
    "distance_default": f"""
SELECT query_id, key, distance, CASE WHEN distance = 0 THEN 1.0::DOUBLE ELSE distance END AS scoring_distance,
       distance AS plain_distance FROM ({knn('list_cosine_distance', 5)})""",
    "combined_score": f"""{RANKED}
SELECT query_id, key, distance, round(lexical, 6) AS lexical, round(score, 6) AS score FROM ranked""",
    "rerank": f"{RANKED} SELECT query_id, raw_rank, score_rank, key FROM ranked",
    "document_key": """
SELECT doc_id, CASE lang WHEN 'es' THEN 'unknown' WHEN 'en' THEN 'kb/' || source ELSE 'doc ' || doc_id END AS doc_key
FROM documents""",
    "diversity_cap": f"{RANKED} SELECT query_id, rank, score_rank, id AS key, doc_key FROM sources",
    "retrieval_stats": f"""{RANKED}
SELECT query_id, count(*) AS raw_count, count(*) FILTER (doc_rank <= 2 AND taken <= 4) AS final_count,
       count(*) FILTER (doc_rank > 2 AND taken < 4) AS dropped_by_cap,
       count(DISTINCT CASE WHEN doc_rank <= 2 AND taken <= 4 THEN doc_key END) AS docs_represented
FROM marked GROUP BY query_id""",
    "snippet": f"WITH {CHUNKS} SELECT key, {snippet('chunk_text')} AS snippet FROM chunks",
    "source_item": f"""{RANKED}
SELECT query_id, rank,
       CASE WHEN source_path = 'fr' THEN sha256(query_id || chr(31) || rank || chr(31) || source_path || chr(31) || chunk_text)
            ELSE id END AS id,
       title, source_path, snippet, doc_type, chunk_index, distance FROM sources""",
    "retrieve_filtered": f"{FILTERED} SELECT {SOURCE_COLUMNS} FROM sources",
    "retrieve": f"{RETRIEVED} SELECT {SOURCE_COLUMNS} FROM sources",
    "retrieve_stored": f"{RETRIEVED} SELECT {SOURCE_COLUMNS} FROM sources",
    "history_window": history(20),
    "history_window_short": history(2, ""),
    "rewrite_context": f"SELECT session_id, seq, context FROM ({CONTEXT})",
    "rewrite_request": f"""
SELECT session_id, seq, CASE WHEN seq > 0 THEN 'CONVERSATION HISTORY:' || chr(10) || context || chr(10) || chr(10)
       || 'FOLLOW-UP: ' || content END AS request FROM ({CONTEXT})""",
    "rewrite_merge": f"""
SELECT session_id, seq, CASE WHEN seq = 0 OR length(content) <= 100 THEN content WHEN length(content) > 250 THEN ''
       ELSE regexp_replace(lower(content), '^{WS}|{WS}$', '', 'g') END AS search_text
FROM ({MESSAGES}) WHERE role = 'user'""",
    "session_assign": """
SELECT conv_id || '#' || turn AS request_id,
       CASE WHEN role = 'user' THEN CAST(conv_id AS VARCHAR) ELSE sha256(conv_id || '#' || turn) END AS session_id
FROM conversations""",
    "turn_commit": f"""WITH {TURNS},
ends AS (SELECT conv_id AS session_id, max(turn) + 1 AS e FROM conversations GROUP BY 1),
placed AS (SELECT t.*, e + 2 * (row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1) AS s FROM turns t JOIN ends USING (session_id))
{MESSAGES}
UNION ALL SELECT session_id, CAST(s AS INTEGER), 'user', message FROM placed
UNION ALL SELECT session_id, CAST(s + 1 AS INTEGER), 'assistant', answer FROM placed""",
    "turn_commit_log": f"""WITH {TURNS},
ends AS (SELECT conv_id AS session_id, max(turn) + 1 AS e FROM conversations GROUP BY 1),
placed AS (SELECT t.*, e + 2 * (row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1) AS s FROM turns t JOIN ends USING (session_id))
{MESSAGES}
UNION ALL SELECT session_id, CAST(s AS INTEGER), 'user', message FROM placed
UNION ALL SELECT session_id, CAST(s + 1 AS INTEGER), 'assistant', answer FROM placed""",
    "chat_response": f"""WITH {ranked_ctes(USER_TURNS, CHUNKS, 0.3)}, {TURNS},
listed AS (SELECT query_id, string_agg(id, ',' ORDER BY rank) AS ids FROM sources GROUP BY query_id)
SELECT turn_id, session_id, answer AS response, coalesce(ids, '') AS source_ids, ids IS NOT NULL AS retrieval_used
FROM turns LEFT JOIN listed ON query_id = turn_id""",
    "source_heading": f"""{RETRIEVED}
SELECT query_id, rank, {HEADING} AS heading
FROM (SELECT * REPLACE (CASE WHEN chunk_index > 0 THEN title ELSE '' END AS title) FROM sources)""",
    "retrieval_block": f"{RETRIEVED} SELECT query_id, {BLOCK} AS block FROM sources GROUP BY query_id",
    "system_text": f"""WITH {ranked_ctes(QUESTIONS, CHUNKS, 0.3)},
blocks AS (SELECT query_id, {BLOCK} AS block FROM sources GROUP BY query_id)
SELECT query_id, 'You answer from sources about item ' || query_id || coalesce(chr(10) || chr(10) || block, '') AS system_text
FROM q LEFT JOIN blocks USING (query_id)""",
    "model_request": f"""WITH {ranked_ctes(USER_TURNS, CHUNKS)},
blocks AS (SELECT query_id, {BLOCK} AS block FROM sources GROUP BY query_id),
past AS ({history(20)})
SELECT q.query_id, 'You answer from sources.' || chr(10) || 'Now: 2024-01-02 03:04:05' || coalesce(chr(10) || chr(10) || block, '') AS system_text,
       CASE WHEN n > 0 THEN history || '|' ELSE '' END || 'user=' || query AS messages, '2000/0.7/0.9' AS settings
FROM q JOIN past ON q.query_id = past.session_id || '#' || past.seq LEFT JOIN blocks USING (query_id)""",
    "chat_turn": f"""WITH {ranked_ctes(LAST_TURNS, CHUNKS)},
blocks AS (SELECT query_id, {BLOCK} AS block, count(*) AS n_sources FROM sources GROUP BY query_id),
past AS ({history(20)}),
open AS (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id),
answered AS (SELECT o.*, (SELECT count(*) FROM conversations c WHERE c.conv_id = o.conv_id AND c.turn < t) AS before, a.text AS response
             FROM open o LEFT JOIN conversations a ON a.conv_id = o.conv_id AND a.turn = t + 1 AND a.role = 'assistant')
SELECT q.query_id, 'You answer from sources.' || chr(10) || 'Now: 2024-01-02 03:04:05' || coalesce(chr(10) || chr(10) || block, '') AS system_text,
       CASE WHEN n > 0 THEN history || '|' ELSE '' END || 'user=' || query AS messages,
       CAST(before + CASE WHEN response IS NULL THEN 0 ELSE 2 END AS BIGINT) AS n_log, response,
       CASE WHEN response IS NOT NULL THEN CAST(coalesce(n_sources, 0) AS BIGINT) END AS n_sources
FROM q JOIN past ON q.query_id = past.session_id || '#' || past.seq
JOIN answered ON q.query_id = conv_id || '#' || t LEFT JOIN blocks USING (query_id)""",
    "stream_ingest": f"""WITH {CHUNKS}
SELECT key, source_path, title, chunk_index, md5(chunk_text) AS text_md5 FROM chunks""",
    "stream_history": history(20),
    "stream_history_late": f"SELECT session_id, CAST(seq * seq * 3 AS INTEGER) AS seq, n, history FROM ({history(20)})",
    "stream_retrieve": f"{RETRIEVED} SELECT {SOURCE_COLUMNS} FROM sources",
}
