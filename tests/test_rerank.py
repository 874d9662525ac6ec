import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.rerank import (
    diversify, doc_key, rerank, retrieval_stats, score_hits, scoring_distance, to_sources,
)
from corpusflow.plans.retrieve import retrieve, retrieve_texts
from corpusflow.operators.embedding import embed, hashing_embedder
from corpusflow.plans.ingest import embed_documents

HITS = (
    "query_id string, query string, raw_rank int, key string, distance double, title string, "
    "source_path string, doc_type string, chunk_index int, chunk_text string"
)


# Query words found, and distance, per hit: two parts of one file, one of them nearest without a
# shared word; a long text.
GARDEN = [
    ("g1", 0.3, "Pruning", "kb/trees.md", "prune the old pear tree in winter"),
    ("g2", 0.1, "Pruning, continued", "kb/trees.md", "tools and gloves"),
    ("g3", 0.4, "Pears", "kb/pears.md", "a pear tree wants sun"),
    ("g4", 0.35, "Hedges", "kb/hedges.md", "cut the hedge near the pear in May " * 12),
]


@pytest.fixture
def listing_hits(spark):
    return rerank(score_hits(spark.createDataFrame(
        [("q", "pear tree", i, k, d, t, p, None, None, c) for i, (k, d, t, p, c) in enumerate(GARDEN, 1)], HITS
    )))


def test_listing_order(listing_hits):
    words = {"pear", "tree"}
    overlap = {k: len(words & set(c.split())) / len(words) for k, _, _, _, c in GARDEN}
    expected = {k: 1 - d + 0.5 * overlap[k] for k, d, _, _, _ in GARDEN}
    got = {r.key: r for r in listing_hits.collect()}
    for key, score in expected.items():
        assert got[key].lexical == overlap[key] and got[key].score == pytest.approx(score)
    sources = to_sources(diversify(listing_hits, cap=1, n=3)).orderBy("rank").collect()
    by_score = sorted(expected, key=lambda k: -expected[k])
    assert [s.id for s in sources] == [k for k in by_score if k != "g2"]
    long = next(s for s in sources if s.id == "g4")
    assert long.snippet.endswith("…") and len(long.snippet) <= 280


@pytest.mark.parametrize("cap,n,ids,dropped", [
    (1, 3, ["g1", "g3", "g4"], 1),
    (1, 4, ["g1", "g3", "g4"], 1),
    (2, 4, ["g1", "g3", "g2", "g4"], 0),
])
def test_listing_cap(listing_hits, cap, n, ids, dropped):
    assert [r.key for r in diversify(listing_hits, cap, n).orderBy("rank").collect()] == ids
    stats = retrieval_stats(listing_hits, cap, n).first()
    assert (stats.raw_count, stats.final_count, stats.dropped_by_cap, stats.docs_represented) == (4, len(ids), dropped, 3)


def test_random_hits_match_a_greedy_walk(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for q in range(80):
        cap, n, size = 2, 4, rng.randint(1, 12)
        hits = [
            (rng.choice([None, 0.0, 0.1, 0.25, 0.5, 1.4]), rng.choice(["a", "b", "c", "", None]),
             rng.choice(["x", "", None]), rng.choice(["one two", "one", "three"]))
            for _ in range(size)
        ]
        rows += [(str(q), "one two", i, f"{q}-{i}", d, t, p, None, None, c) for i, (d, p, t, c) in enumerate(hits, 1)]
        scored = []
        for i, (d, p, t, c) in enumerate(hits, 1):
            score = (1.0 - (d or 1.0)) + len({"one", "two"} & set(c.split())) / 2 * 0.5
            scored.append((score, f"{q}-{i}", p or t or "unknown"))
        order = sorted(scored, key=lambda s: -s[0])
        docs = [doc for _, _, doc in order]
        allowed = [i for i in range(size) if docs[:i].count(docs[i]) < cap]
        kept = allowed[:n]
        end = kept[-1] if len(kept) == n else size
        dropped = len(set(range(end)) - set(allowed))
        expected[str(q)] = ([order[i][1] for i in kept], size, len(kept), dropped, len({docs[i] for i in kept}))
    ranked = rerank(score_hits(spark.createDataFrame(rows, HITS).repartition(4)))
    got = {}
    for r in diversify(ranked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.key)
    for s in retrieval_stats(ranked).collect():
        found = (got[s.query_id], s.raw_count, s.final_count, s.dropped_by_cap, s.docs_represented)
        assert found == expected[s.query_id]


def test_scoring_distance(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.3,), (1.4,)], "d double")
    got = df.select(scoring_distance(F.col("d")), scoring_distance(F.col("d"), zero_is_missing=False)).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (1.0, 0.0), (0.3, 0.3), (1.4, 1.4)]


def test_doc_key(spark):
    df = spark.createDataFrame([("p", "t"), ("", "t"), (None, "t"), (None, ""), (None, None)], "p string, t string")
    assert [r[0] for r in df.select(doc_key(F.col("p"), F.col("t"))).collect()] == ["p", "t", "t", "unknown", "unknown"]


def test_sources_without_key_or_text(spark):
    rows = [("q", 1, None, 0.1, "t", "p", None, 3, None), ("q", 2, "", None, None, None, ".md", None, "x")]
    df = spark.createDataFrame(rows, "query_id string, rank int, key string, distance double, title string, "
                                     "source_path string, doc_type string, chunk_index int, chunk_text string")
    one, two = to_sources(df).orderBy("rank").collect()
    assert len(one.id) == 64 and len(two.id) == 64 and one.id != two.id
    assert one.snippet == "" and one.chunk_index == 3 and two.distance is None


def test_retrieve_end_to_end(spark):
    docs = spark.createDataFrame(
        [("cats.md", "cats purr and sleep"), ("dogs.md", "dogs bark at cats"), ("tax.md", "income tax forms")],
        "filename string, content string",
    )
    vectors = embed_documents(docs, hashing_embedder(256))
    asked = spark.createDataFrame([("1", "do cats purr"), ("2", ""), ("3", "tax forms")], "query_id string, query string")
    rows = retrieve_texts(asked, vectors, hashing_embedder(256), return_n=1, dim=256).collect()
    assert {r.query_id: r.title for r in rows} == {"1": "cats", "3": "tax"}
    assert retrieve(embed(asked, "query", hashing_embedder(256)), vectors, enabled=False, dim=256).count() == 0


def test_rerank_chain_has_one_exchange(spark, listing_hits):
    plan = to_sources(diversify(listing_hits))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
