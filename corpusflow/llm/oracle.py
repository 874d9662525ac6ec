"""DuckDB SQL of the queries that SQL can express."""

from corpusflow.llm.queries import LISTED_SITES, PROBE, RULES
from corpusflow.llm.url_filter import JUNK_RUNS, SYMBOL_RUNS

_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
_SITES = ", ".join(f"('{host}')" for host in LISTED_SITES)
_PROBE = ", ".join(f"({conv}, {turn}, '{role}', '{text}')" for conv, turn, role, text in PROBE)
# The length of a text with a backslash put into each `<`, any backslashes, `|`.
_ESCAPED = r"length(regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g'))"

ORACLE = {
    "op1_url_filter": f"""
        WITH rules(rule_host, rule_path, says) AS (VALUES {_RULES}), sites(site) AS (VALUES {_SITES}),
        rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r,
                   coalesce(len(regexp_extract_all(html, '{SYMBOL_RUNS}')) * 1000 > {JUNK_RUNS} * length(html), false) AS junk
            FROM pages
        ),
        parts AS (
            SELECT page_id, junk,
                   translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest
        ),
        named AS (
            SELECT *, regexp_replace(regexp_replace(host, ':(80|443)\\z', ''), '^(www|m)\\.', '') AS site_host,
                   regexp_replace(path, '(/index\\.html?|\\.html?)?/*\\z', '') AS page_path
            FROM parts WHERE host <> ''
        ),
        spelled AS (
            SELECT host, path, bool_or(listed) AS url_listed
            FROM (SELECT host, path, bool_or(junk) OVER (PARTITION BY site_host, page_path) AS listed FROM named) GROUP BY host, path
        ),
        verdicts AS (
            SELECT host, path,
                   (SELECT max_by(struct_pack(rule := rule_host || rule_path, says := says), length(rule_host) + length(rule_path)) FROM rules
                    WHERE (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best,
                   EXISTS (SELECT 1 FROM sites WHERE host = site OR suffix(host, '.' || site)) AS listed
            FROM (SELECT DISTINCT host, path FROM parts)
        )
        SELECT page_id, host, path, best.rule AS rule,
               coalesce(best.says, CASE WHEN listed OR url_listed THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts JOIN verdicts USING (host, path) LEFT JOIN spelled USING (host, path)
    """,
    "op11_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {_PROBE})
        ),
        whole AS (
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                   coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS learned,
                   CAST(sum({_ESCAPED.format("role")} + {_ESCAPED.format("text")} + 32) AS BIGINT) AS formatted_chars
            FROM turns GROUP BY conv_id
        )
        SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
        FROM whole
    """,
    "op13_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ),
        words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        sources AS (SELECT DISTINCT lang, source FROM docs),
        found AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
        dense AS (
            SELECT lang, source, term, coalesce(c, 0) AS c
            FROM sources JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)
        ),
        shares AS (
            SELECT lang, source, term, c, v,
                   1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS p,
                   1 + (1000000000::HUGEINT * (sum(c) OVER (PARTITION BY lang, term) + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * v) AS q
            FROM dense JOIN sizes USING (lang)
        ),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
            FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (
                SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
                FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
            ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ),
        parts AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM parts
        QUALIFY part = 'pair' OR rank <= 50
    """,
}
