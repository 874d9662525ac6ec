"""The registered queries: every operator over the whole of the given tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import lexical_score, snippet, tokens
from corpusflow.functions.vectors import pool_first, validate_vectors
from corpusflow.operators import conversation as conv
from corpusflow.operators import prompts, rerank
from corpusflow.operators.chunking import ingest_report
from corpusflow.operators.embedding import embed, hashing_embedder
from corpusflow.operators.knn import knn
from corpusflow.plans import chat
from corpusflow.plans.ingest import chunk_documents, embed_documents
from corpusflow.plans.replay import replay, search_texts, turn_id
from corpusflow.plans.retrieve import retrieve, search
from corpusflow.session import materialize, new_path
from corpusflow.sources import files, index, message_log, transcript_files, transcripts
from corpusflow.sources.markdown import read_markdown, split_markdown
from corpusflow.streaming import jobs

DIM = 64
EMBEDDER = hashing_embedder(DIM)
HEADERS = ["## Sources", "Cite them."]


# ---------------------------------------------------------------- inputs


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(spark, sf, name: str) -> DataFrame:
    """A table dealt out by its rows' ids: the given files have one row group, which would be one task's work."""
    rows = table(spark, sf, name)
    return rows.repartition(rows.columns[0])


def documents(spark, sf) -> DataFrame:
    """documents as files."""
    return dealt(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("filename"), F.col("text").alias("content")
    )


def chunks(spark, sf) -> DataFrame:
    return chunk_documents(documents(spark, sf))


def vectors(spark, sf) -> DataFrame:
    return embed_documents(documents(spark, sf), EMBEDDER)


def language_vectors(spark, sf) -> DataFrame:
    """As `vectors`, every language being one large document: here the cap decides."""
    docs = dealt(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("filename"), F.col("text").alias("content"), "lang"
    )
    return embed_documents(docs, EMBEDDER).withColumn("source_path", F.col("lang"))


def questions(spark, sf) -> DataFrame:
    """benchmark texts as queries."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return embed(asked, "query", EMBEDDER)


def vector_pairs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All embeddings as queries and as index."""
    e = table(spark, sf, "embeddings")
    return (
        e.select(F.col("vec_id").alias("query_id"), "embedding", "label"),
        e.select(F.col("vec_id").alias("key"), "embedding", "label"),
    )


def messages(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").cast("int").alias("seq"),
        "role",
        F.col("text").alias("content"),
        F.lit(None).cast("timestamp_ntz").alias("timestamp"),
    )


def turns_and_answers(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Every user message asked once more, answered by the assistant message after it if any."""
    m = messages(spark, sf)
    asked = m.filter("role = 'user'").select(
        turn_id().alias("turn_id"), "session_id", F.col("seq").alias("turn_order"),
        F.col("content").alias("message"), F.col("timestamp").alias("asked_at"),
    )
    after = m.filter("role = 'assistant'").withColumn("seq", F.col("seq") - 1).select(
        turn_id().alias("turn_id"), F.col("content").alias("answer"), F.col("timestamp").alias("answered_at")
    )
    return asked, asked.select("turn_id").join(after, "turn_id", "left")


def user_questions(spark, sf) -> DataFrame:
    return embed(search_texts(messages(spark, sf)), "query", EMBEDDER)


# ---------------------------------------------------------------- sources and sinks


def src_markdown(spark, sf):
    """Documents as .md files, pages as .html and benchmark items as .MD files."""
    def as_files(name: str, path: Column, content: str) -> DataFrame:
        return table(spark, sf, name).select(path.alias("path"), F.col(content).cast("binary").alias("content"))

    every = (
        as_files("documents", F.concat(F.lit("/kb/doc_"), "doc_id", F.lit(".md")), "text")
        .unionByName(as_files("pages", F.concat(F.lit("/web/page_"), "page_id", F.lit(".html")), "html"))
        .unionByName(as_files("benchmark", F.concat(F.lit("/kb/item_"), "item_id", F.lit(".MD")), "text"))
    )
    docs, rejects = split_markdown(every)
    return docs.select(
        "filename", F.lit("document").alias("outcome"), F.md5(F.col("content").cast("binary")).alias("content_md5")
    ).unionByName(
        rejects.select("filename", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("content_md5"))
    )


def markdown_folder(spark, sf):
    """The files of `src_markdown` written to a folder with sub-folders, listed and read from there; every tenth
    document's file is empty."""
    path = new_path(spark, "kb")
    empty = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text"))
    every = (
        table(spark, sf, "documents")
        .select(F.concat(F.lit("kb/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".md")).alias("path"), empty.alias("text"))
        .unionByName(table(spark, sf, "pages").select(F.concat(F.lit("web/page_"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("text")))
        .unionByName(table(spark, sf, "benchmark").select(F.concat(F.lit("item_"), "item_id", F.lit(".MD")).alias("path"), "text"))
    )
    files.write_files(every.select("path", F.col("text").cast("binary").alias("content")), path)
    docs, rejects = read_markdown(spark, path)
    return docs.select(
        "filename", F.lit("document").alias("outcome"), F.md5(F.col("content").cast("binary")).alias("content_md5")
    ).unionByName(
        rejects.select("filename", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("content_md5"))
    )


def chunk_text(spark, sf):
    return chunks(spark, sf).select("filename", "chunk_index", "chunk_text")


def chunk_metadata(spark, sf):
    return chunks(spark, sf).select(
        "key", "filename", "source_path", "title", "doc_type", "chunk_index",
        F.length("chunk_text").alias("n_chars"),
    )


def ingest_report_query(spark, sf):
    docs = documents(spark, sf)
    return ingest_report(docs, chunk_documents(docs))


def _revised(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The index of all documents, and what a second ingest puts: good documents rewritten
    without vowels (shorter, so with fewer chunks) and the benchmark items as new files."""
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    rewritten = table(spark, sf, "documents").join(good, "doc_id").select(
        F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("filename"),
        F.translate("text", "aeiou", "").alias("content"),
    )
    new = table(spark, sf, "benchmark").select(
        F.concat(F.lit("item_"), "item_id", F.lit(".md")).alias("filename"), F.col("text").alias("content")
    )
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    return (
        chunks(spark, sf).withColumn("version", one),
        chunk_documents(rewritten.unionByName(new)).withColumn("version", two),
    )


def _upserted(spark, sf, replace_document):
    current, incoming = _revised(spark, sf)
    return index.upsert(current, incoming, replace_document).select(
        "key", "chunk_index", "version", F.md5(F.col("chunk_text").cast("binary")).alias("text_md5")
    )


def vector_upsert(spark, sf):
    return _upserted(spark, sf, False)


def vector_upsert_replace(spark, sf):
    return _upserted(spark, sf, True)


def _through_log(spark, sf, replace_document):
    """As _upserted, through a stored index: the first rows come by the log, are folded, the second
    are put, then the first come by the log again and are folded again, which changes nothing."""
    path = new_path(spark, "log-index")
    none = F.lit(None).cast("array<float>")
    current, incoming = (rows.withColumn("embedding", none) for rows in _revised(spark, sf))
    index.append_log(current, path, "kb", 0)
    index.compact(spark, path, replace_document, buckets=8)
    index.put(spark, path, incoming, replace_document)
    index.append_log(current, path, "kb", 1)
    index.compact(spark, path, replace_document)
    return index.read_index(spark, path).select(
        "key", "chunk_index", "version", F.md5(F.col("chunk_text").cast("binary")).alias("text_md5")
    )


def vector_upsert_log(spark, sf):
    return _through_log(spark, sf, False)


def vector_upsert_log_replace(spark, sf):
    return _through_log(spark, sf, True)


def vector_scan(spark, sf):
    path = new_path(spark, "index")
    index.write_snapshot(vectors(spark, sf).withColumn("version", F.lit(1).cast("long")), path, buckets=8)
    return index.read_index(spark, path).select(
        "key", "filename", "source_path", "title", "doc_type", "chunk_index", "version",
        F.length("chunk_text").alias("n_chars"), F.coalesce(F.size("embedding"), F.lit(0)).alias("dim"),
    )


def retrieve_filtered(spark, sf):
    """Sources from first chunks of some documents only, in a stored index whose first documents were put again."""
    path = new_path(spark, "filtered-index")
    known = vectors(spark, sf)
    index.write_snapshot(known.withColumn("version", F.lit(1).cast("long")), path, buckets=8)
    again = known.filter("title < 'doc_2'").withColumn("version", F.lit(2).cast("long"))
    index.put(spark, path, again.withColumn("source_path", F.lit("put/again")))
    where = F.col("source_path").between("api_upload/doc_1", "api_upload/doc_5") & (F.col("chunk_index") == 0)
    return _source_columns(retrieve(questions(spark, sf), index.read_index(spark, path, where=where), dim=DIM))


def retrieve_stored(spark, sf):
    """Sources whose texts are fetched by key from a stored index, a part of which was put again."""
    path = new_path(spark, "stored-index")
    known = vectors(spark, sf)
    index.write_snapshot(known.withColumn("version", F.lit(1).cast("long")), path, buckets=8)
    index.put(spark, path, known.filter("title < 'doc_2'").withColumn("version", F.lit(2).cast("long")))
    stored, fetch = index.open_index(spark, path)
    return _source_columns(retrieve(questions(spark, sf), stored, dim=DIM, fetch=fetch))


def transcript_scan(spark, sf):
    """Histories of as many session ids as there are documents, most of them unknown."""
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("session_id"))
    return conv.history(messages(spark, sf), asked).select("session_id", "seq", "role", "content")


def transcript_sink(spark, sf):
    """Sessions written as JSON arrays, three messages to a part, and read back."""
    path = new_path(spark, "transcripts")
    transcripts.write_transcripts(messages(spark, sf), path, 3)
    back = transcripts.read_written_transcripts(spark, path, T.LongType())
    return back.select("session_id", "seq", "role", "content")


def transcript_files_query(spark, sf):
    """Sessions written as files of their own, and read from them."""
    path = new_path(spark, "transcript-files")
    transcript_files.write_transcript_files(messages(spark, sf), path)
    back = transcript_files.read_transcript_files(spark, path)
    return back.select(F.col("session_id").cast("long").alias("session_id"), "seq", "role", "content")


def transcript_log(spark, sf):
    """Messages appended to the log and read back."""
    path = new_path(spark, "messages")
    rows = messages(spark, sf)
    transcripts.append_messages(rows, path, 8)
    return transcripts.read_messages(spark, path, rows.schema).select("session_id", "seq", "role", "content")


# ---------------------------------------------------------------- chunking and embedding


def embed_query(spark, sf):
    return vectors(spark, sf).select("key", F.posexplode("embedding").alias("bucket", "w")).filter("w > 0").select(
        "key", "bucket", F.round(F.col("w").cast("double"), 6).alias("weight")
    )


def pool_first_vector(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.col("embedding")
    shapes = {"three": F.array(F.array(v, F.reverse(v))), "two": F.array(v, F.reverse(v)), "flat": v}
    pooled = None
    for name, value in shapes.items():
        part = pool_first(e.select("vec_id", F.lit(name).alias("shape"), value.alias("output")), "output")
        part = part.select("vec_id", "shape", "embedding")
        pooled = part if pooled is None else pooled.unionByName(part)
    return pooled.select("vec_id", "shape", F.posexplode("embedding").alias("pos", "x")).select(
        "vec_id", "shape", "pos", F.round(F.col("x").cast("double"), 6).alias("value")
    )


def _damaged(col: str = "embedding") -> Column:
    """Vectors of label 0 missing, of label 1 one component too long."""
    v = F.col(col)
    return F.when(F.col("label") == 1, F.concat(v, F.array(F.lit(0.5).cast("float")))).when(F.col("label") != 0, v)


def vector_cast_check(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", _damaged().cast(T.ArrayType(T.DoubleType())).alias("embedding")
    )
    good, bad = validate_vectors(e, DIM)
    return good.select("vec_id", F.lit("ok").alias("outcome")).unionByName(
        bad.select("vec_id", F.col("reason").alias("outcome"))
    )


# ---------------------------------------------------------------- vector search


def knn_cosine(spark, sf):
    q, v = vector_pairs(spark, sf)
    return knn(q, v, 12, dim=DIM)


def knn_cosine_cells(spark, sf):
    """As knn_cosine, by the way for two large sides."""
    q, v = vector_pairs(spark, sf)
    return knn(q, v, 12, dim=DIM, max_broadcast_queries=0, n_cells=16)


def knn_euclidean(spark, sf):
    q, v = vector_pairs(spark, sf)
    return knn(q, v, 12, dim=DIM, metric="euclidean")


def knn_euclidean_cells(spark, sf):
    q, v = vector_pairs(spark, sf)
    return knn(q, v, 12, dim=DIM, metric="euclidean", max_broadcast_queries=0, n_cells=16)


def distance_cutoff(spark, sf):
    q, v = vector_pairs(spark, sf)
    return knn(q, v, 12, dim=DIM, metadata=["label"], max_distance=0.5)


def search_gate(spark, sf):
    q, v = vector_pairs(spark, sf)
    hits = knn(q.withColumn("embedding", _damaged()), v, 3, dim=DIM)
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    return q.select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_hits")
    )


# ---------------------------------------------------------------- rerank and selection


def tokenize_ws(spark, sf):
    t = dealt(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


def lexical_overlap(spark, sf):
    """Every message scored against the one after it."""
    m = messages(spark, sf).select("session_id", "seq", "content")
    after = m.select("session_id", (F.col("seq") - 1).alias("seq"), F.col("content").alias("next"))
    return m.join(after, ["session_id", "seq"]).select(
        "session_id", "seq", F.round(lexical_score(F.col("content"), F.col("next")), 6).alias("lexical")
    )


def distance_default(spark, sf):
    """Each vector finds itself at distance zero."""
    q, v = vector_pairs(spark, sf)
    d = F.col("distance")
    return knn(q, v, 5, dim=DIM).select(
        "query_id", "key", "distance",
        rerank.scoring_distance(d).alias("scoring_distance"),
        rerank.scoring_distance(d, zero_is_missing=False).alias("plain_distance"),
    )


def _ranked(spark, sf):
    return search(questions(spark, sf), language_vectors(spark, sf), dim=DIM)


def combined_score(spark, sf):
    return _ranked(spark, sf).select(
        "query_id", "key", "distance", F.round("lexical", 6).alias("lexical"), F.round("score", 6).alias("score")
    )


def rerank_query(spark, sf):
    return _ranked(spark, sf).select("query_id", "raw_rank", "score_rank", "key")


def document_key(spark, sf):
    """Paths missing for French, empty for Spanish and German texts; titles empty for Spanish."""
    d = table(spark, sf, "documents")
    path = F.when(F.col("lang").isin("es", "de"), "").when(F.col("lang") != "fr", F.concat(F.lit("kb/"), "source"))
    title = F.when(F.col("lang") == "es", "").otherwise(F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    return d.select("doc_id", rerank.doc_key(path, title).alias("doc_key"))


def diversity_cap(spark, sf):
    return rerank.diversify(_ranked(spark, sf)).select("query_id", "rank", "score_rank", "key", "doc_key")


def retrieval_stats(spark, sf):
    return rerank.retrieval_stats(_ranked(spark, sf))


def snippet_query(spark, sf):
    return chunks(spark, sf).select("key", snippet(F.col("chunk_text")).alias("snippet"))


def source_item(spark, sf):
    """Sources of hits in the language index; keys of French texts are empty."""
    kept = rerank.diversify(_ranked(spark, sf))
    blank = kept.withColumn("key", F.when(F.col("source_path") != "fr", F.col("key")).otherwise(""))
    return _source_columns(rerank.to_sources(blank))


def _source_columns(sources):
    return sources.select(
        "query_id", "rank", "id", "title", "source_path", "snippet", "doc_type", "chunk_index", "distance"
    )


def retrieve_query(spark, sf):
    return _source_columns(retrieve(questions(spark, sf), vectors(spark, sf), dim=DIM))


# ---------------------------------------------------------------- conversations


def _rendered(history: Column) -> Column:
    return F.array_join(F.transform(history, lambda m: F.concat(m["role"], F.lit("="), m["content"][0]["text"])), "|")


def history_window(spark, sf):
    return conv.with_history(messages(spark, sf)).select(
        "session_id", "seq", F.size("history").alias("n"), _rendered(F.col("history")).alias("history")
    )


def history_window_short(spark, sf):
    """Windows of two messages over blocks of three: most windows cross a block border."""
    past = conv.with_previous(
        messages(spark, sf), 2, conv.model_message(F.col("role"), F.col("content")), "history", block=3
    )
    return past.select("session_id", "seq", F.size("history").alias("n"), _rendered(F.col("history")).alias("history"))


def rewrite_context(spark, sf):
    return conv.rewrite_context(messages(spark, sf)).select("session_id", "seq", "context")


def rewrite_request(spark, sf):
    turns = conv.rewrite_request(conv.rewrite_context(messages(spark, sf)))
    return turns.select("session_id", "seq", "request")


def rewrite_merge(spark, sf):
    """Rewrites by length of the message: none, a padded one, a blank one."""
    turns = conv.rewrite_context(messages(spark, sf))
    n = F.length("content")
    text = F.when(n > 250, F.lit(" \n ")).when(n > 100, F.concat(F.lit("\t "), F.lower("content"), F.lit(" \n")))
    rewrites = turns.select("session_id", "seq", text.alias("rewritten"))
    return conv.merge_rewrites(turns, rewrites, ["session_id", "seq"]).select("session_id", "seq", "search_text")


def session_assign(spark, sf):
    """User rows bring their session, assistant rows an empty one, system rows none."""
    session = F.when(F.col("role") == "user", F.col("session_id").cast("string")).when(F.col("role") == "assistant", "")
    requests = messages(spark, sf).select(turn_id().alias("request_id"), session.alias("session_id"))
    return conv.assign_sessions(requests).select("request_id", "session_id")


def turn_commit(spark, sf):
    turns, answers = turns_and_answers(spark, sf)
    return conv.commit_turns(messages(spark, sf), turns, answers).select("session_id", "seq", "role", "content")


def turn_commit_log(spark, sf):
    """The turns of `turn_commit` in two commits to a stored log, the first of them done twice."""
    path = new_path(spark, "turn-log")
    rows = messages(spark, sf)
    schema = message_log.logged(rows.schema)
    message_log.append_messages(spark, path, rows, schema, buckets=8)
    turns, answers = turns_and_answers(spark, sf)
    early = F.col("turn_order") < 3
    for part in (turns.filter(early), turns.filter(early), turns.filter(~early)):
        message_log.commit_turns(spark, path, part, answers, schema)
    return message_log.read_log(spark, path, schema=schema).select("session_id", "seq", "role", "content")


def chat_response(spark, sf):
    """With a cutoff that leaves some turns without sources."""
    turns, answers = turns_and_answers(spark, sf)
    sources = retrieve(user_questions(spark, sf), vectors(spark, sf), dim=DIM, max_distance=0.3)
    ids = F.transform("sources", lambda s: s["id"])
    return conv.responses(turns, sources, answers).select(
        "turn_id", "session_id", "response", F.array_join(ids, ",").alias("source_ids"), "retrieval_used"
    )


# ---------------------------------------------------------------- prompts


def _sources(spark, sf):
    return retrieve(questions(spark, sf), vectors(spark, sf), dim=DIM)


def source_heading(spark, sf):
    """Headings where titles of first chunks are empty."""
    s = _sources(spark, sf).withColumn("title", F.when(F.col("chunk_index") > 0, F.col("title")).otherwise(""))
    return s.select("query_id", "rank", prompts.source_heading().alias("heading"))


def retrieval_block(spark, sf):
    return prompts.retrieval_block(_sources(spark, sf), HEADERS).select("query_id", "block")


def system_text(spark, sf):
    """Block per query; queries for which a cutoff leaves no source have the base prompt alone."""
    asked = questions(spark, sf)
    blocks = prompts.retrieval_block(retrieve(asked, vectors(spark, sf), dim=DIM, max_distance=0.3), HEADERS)
    base = F.concat(F.lit("You answer from sources about item "), F.col("query_id").cast("string"))
    return asked.select("query_id").join(blocks, "query_id", "left").select(
        "query_id", prompts.system_text(base, F.col("block")).alias("system_text")
    )


def model_request(spark, sf):
    """A request for every user turn of every conversation, with its retrieved sources."""
    as_of = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    base = prompts.base_prompt("You answer from sources.\nNow: {as_of}", as_of)
    requests, _ = replay(
        messages(spark, sf), vectors(spark, sf), base, embedder=EMBEDDER, header_lines=HEADERS, dim=DIM
    )
    settings = F.concat_ws("/", *[F.col(f"inferenceConfig.{c}").cast("string") for c in ("maxTokens", "temperature", "topP")])
    return requests.select(
        "query_id", F.col("system")[0]["text"].alias("system_text"), _rendered(F.col("messages")).alias("messages"),
        settings.alias("settings"),
    )


def chat_turn(spark, sf):
    """The last user message of every conversation arrives as a request, the log holding the
    messages before it; answered as in the data, committed twice."""
    m = messages(spark, sf)
    last = m.filter("role = 'user'").groupBy("session_id").agg(F.max("seq").alias("turn_order"))
    marked = m.join(last, "session_id", "left")
    log = marked.filter("turn_order is null or seq < turn_order").select(
        *m.columns, F.lit(None).cast("string").alias("turn_id")
    )
    turns = chat.open_turns(
        marked.filter("seq = turn_order").select(
            turn_id().alias("request_id"), F.col("session_id").cast("string").alias("session_id"), "turn_order",
            F.col("content").alias("message"), F.col("timestamp").alias("asked_at"),
        )
    ).withColumn("session_id", F.col("session_id").cast("long"))
    answers = marked.filter("role = 'assistant' and seq = turn_order + 1").select(
        F.concat_ws("#", "session_id", "turn_order").alias("turn_id"), F.col("content").alias("answer"),
        F.col("timestamp").alias("answered_at"),
    )
    as_of = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    base = prompts.base_prompt("You answer from sources.\nNow: {as_of}", as_of)
    requests, sources = chat.chat_requests(
        log, turns, vectors(spark, sf), base, embedder=EMBEDDER, header_lines=HEADERS, dim=DIM
    )
    once, _ = chat.close_turns(log, turns, sources, answers)
    twice, responses = chat.close_turns(materialize(once, "chat-log"), turns, sources, answers)
    sizes = twice.groupBy("session_id").agg(F.count("*").alias("n_log"))
    asked = turns.select(F.col("turn_id").alias("query_id"), "session_id")
    answered = responses.select(F.col("turn_id").alias("query_id"), "response", F.size("sources").alias("n_sources"))
    return (
        requests.join(asked, "query_id").join(sizes, "session_id", "left").join(answered, "query_id", "left")
        .select(
            "query_id", F.col("system")[0]["text"].alias("system_text"), _rendered(F.col("messages")).alias("messages"),
            F.coalesce("n_log", F.lit(0)).cast("long").alias("n_log"), "response",
            F.col("n_sources").cast("long").alias("n_sources"),
        )
    )


# ---------------------------------------------------------------- streams


def _stream(spark, sf, name):
    """A table's files as a stream, whether it is one file or a folder of them. The path is a pattern, as Spark takes a
    stream's plain path for a folder."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def stream_ingest(spark, sf):
    """Documents arriving as a stream, appended to the log and folded into a snapshot."""
    path = new_path(spark, "stream-index")
    docs = _stream(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("filename"), F.col("text").alias("content"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime"),
    )
    jobs.stream_ingest(docs, path, f"{path}/progress", EMBEDDER).awaitTermination()
    index.compact(spark, path, buckets=8)
    return index.read_index(spark, path).select(
        "key", "source_path", "title", "chunk_index", F.md5(F.col("chunk_text").cast("binary")).alias("text_md5")
    )


def stream_outcomes(spark, sf):
    """What became of each streamed document, half of them folded into the index."""
    path = new_path(spark, "stream-outcomes")
    rows = table(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("filename"), F.col("text").alias("content"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime"), (F.col("doc_id") % 2).alias("half"),
    )
    for half in (0, 1):
        rows.filter(F.col("half") == half).drop("half").write.mode("append").parquet(f"{path}/in")
        arriving = spark.readStream.schema(rows.drop("half").schema).parquet(f"{path}/in")
        jobs.stream_ingest(arriving, f"{path}/index", f"{path}/progress", EMBEDDER).awaitTermination()
        if not half:
            index.compact(spark, f"{path}/index", buckets=8)
    return jobs.ingest_outcomes(spark, f"{path}/index").select("filename", "chunks_indexed", "status", "searchable")


def stream_history(spark, sf):
    path = new_path(spark, "stream-history")
    arriving = _stream(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("seq"), "role", F.col("text").alias("content")
    )
    jobs.stream_history(arriving, path, f"{path}/progress").awaitTermination()
    lines = F.zip_with("roles", "contents", lambda r, c: F.concat(r, F.lit("="), c))
    return jobs.read_histories(spark, path, T.LongType()).select(
        "session_id", "seq", F.size("roles").alias("n"), F.array_join(lines, "|").alias("history")
    )


def stream_history_late(spark, sf):
    """Every third message arrives in a later batch than the rest, and positions have gaps."""
    path = new_path(spark, "stream-history-late")
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") * F.col("turn") * 3).cast("int").alias("seq"), "role",
        F.col("text").alias("content"), (F.col("turn") % 3 == 1).alias("late"),
    )
    for late in (False, True):
        rows.filter(F.col("late") == late).drop("late").write.mode("append").parquet(f"{path}/in")
        arriving = spark.readStream.schema(rows.drop("late").schema).parquet(f"{path}/in")
        jobs.stream_history(arriving, path, f"{path}/progress").awaitTermination()
    lines = F.zip_with("roles", "contents", lambda r, c: F.concat(r, F.lit("="), c))
    return jobs.read_histories(spark, path, T.LongType()).select(
        "session_id", "seq", F.size("roles").alias("n"), F.array_join(lines, "|").alias("history")
    )


def stream_retrieve(spark, sf):
    path = new_path(spark, "stream-retrieve")
    asked = embed(
        _stream(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")),
        "query", EMBEDDER,
    )
    known = vectors(spark, sf)
    jobs.stream_retrieve(asked, known, f"{path}/out", f"{path}/progress", dim=DIM).awaitTermination()
    return _source_columns(spark.read.parquet(f"{path}/out"))


QUERIES = {
    "src_markdown": src_markdown,
    "markdown_folder": markdown_folder,
    "chunk_metadata": chunk_metadata,
    "ingest_report": ingest_report_query,
    "vector_upsert": vector_upsert,
    "vector_upsert_replace": vector_upsert_replace,
    "vector_upsert_log": vector_upsert_log,
    "vector_upsert_log_replace": vector_upsert_log_replace,
    "vector_scan": vector_scan,
    "retrieve_filtered": retrieve_filtered,
    "retrieve_stored": retrieve_stored,
    "transcript_scan": transcript_scan,
    "transcript_sink": transcript_sink,
    "transcript_files": transcript_files_query,
    "transcript_log": transcript_log,
    "chunk_text": chunk_text,
    "embed": embed_query,
    "pool_first_vector": pool_first_vector,
    "vector_cast_check": vector_cast_check,
    "knn_cosine": knn_cosine,
    "knn_cosine_cells": knn_cosine_cells,
    "knn_euclidean": knn_euclidean,
    "knn_euclidean_cells": knn_euclidean_cells,
    "distance_cutoff": distance_cutoff,
    "search_gate": search_gate,
    "tokenize_ws": tokenize_ws,
    "lexical_overlap": lexical_overlap,
    "distance_default": distance_default,
    "combined_score": combined_score,
    "rerank": rerank_query,
    "document_key": document_key,
    "diversity_cap": diversity_cap,
    "retrieval_stats": retrieval_stats,
    "snippet": snippet_query,
    "source_item": source_item,
    "retrieve": retrieve_query,
    "history_window": history_window,
    "history_window_short": history_window_short,
    "rewrite_context": rewrite_context,
    "rewrite_request": rewrite_request,
    "rewrite_merge": rewrite_merge,
    "session_assign": session_assign,
    "turn_commit": turn_commit,
    "turn_commit_log": turn_commit_log,
    "chat_response": chat_response,
    "chat_turn": chat_turn,
    "source_heading": source_heading,
    "retrieval_block": retrieval_block,
    "system_text": system_text,
    "model_request": model_request,
    "stream_ingest": stream_ingest,
    "stream_outcomes": stream_outcomes,
    "stream_history": stream_history,
    "stream_history_late": stream_history_late,
    "stream_retrieve": stream_retrieve,
}
