import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import conversation as conv
from corpusflow.operators.prompts import base_prompt, model_requests, retrieval_block, source_heading, system_text
from corpusflow.plans.replay import replay, rewrite_requests

M = "session_id string, seq int, role string, content string, timestamp timestamp_ntz"
SOURCES = (
    "query_id string, rank int, id string, title string, source_path string, snippet string, doc_type string, "
    "chunk_index int, distance double"
)


def session(name, n, role=lambda i: "user" if i % 2 == 0 else "assistant"):
    return [(name, i, role(i), f"{name}{i}", None) for i in range(n)]


@pytest.fixture
def long_and_short(spark):
    """A session holding most of all messages, some short ones, in random order."""
    rows = session("hot", 2500) + session("s", 25) + session("t", 1)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, M).repartition(6)


def texts(history):
    return [m.content[0].text for m in history]


def test_history_over_block_borders(long_and_short):
    got = {(r.session_id, r.seq): texts(r.history) for r in conv.with_history(long_and_short).collect()}
    for name, n in [("hot", 2500), ("s", 25), ("t", 1)]:
        for i in range(0, n, 2):
            assert got[name, i] == [f"{name}{j}" for j in range(max(0, i - 20), i)]
    assert len(got) == 1250 + 13 + 1


@pytest.mark.parametrize("n,block", [(5, 5), (3, 4), (7, 2), (1, 1)])
def test_windows_for_any_block_size(spark, n, block):
    df = spark.createDataFrame(session("a", 40) + session("b", 3), M)
    got = conv.with_previous(df, n, F.col("content"), "p", block).collect()
    assert len(got) == 43
    assert all(r.p == [f"{r.session_id}{j}" for j in range(max(0, r.seq - n), r.seq)] for r in got)


def test_history_is_not_partitioned_by_session_alone(long_and_short):
    plan = conv.with_history(long_and_short)._jdf.queryExecution().executedPlan().toString()
    exchanges = [part.split(")")[0] for part in plan.split("Exchange hashpartitioning(")[1:]]
    # Only the counts per block, one row each, are brought together by session.
    by_session = [keys for keys in exchanges if "_block" not in keys]
    assert len(by_session) == 1 and len(exchanges) > 1 and "hashpartitioning(session_id" in plan


def test_windows_over_gaps(spark):
    """Positions far apart, and sessions that do not start at 0."""
    df = spark.createDataFrame([("a", s, "user", f"a{s}", None) for s in (0, 1, 5000, 90_000)] +
                               [("b", 1, "user", "b1", None), ("b", 2, "user", "b2", None)], M)
    got = {(r.session_id, r.seq): texts(r.history) for r in conv.with_history(df).collect()}
    assert got["a", 5000] == ["a0", "a1"] and got["a", 90_000] == ["a0", "a1", "a5000"] and got["b", 1] == []
    asked = {(r.session_id, r.seq): r.request for r in conv.rewrite_request(conv.rewrite_context(df)).collect()}
    assert asked["b", 1] is None and asked["b", 2] is not None and asked["a", 5000] is not None


def test_positions_with_gaps(spark):
    rng = random.Random(2)
    rows = [("hot", o) for o in rng.sample(range(100_000), 3000)] + [("a", 5), ("a", 99_999), ("b", 7)]
    df = spark.createDataFrame(rows, "k string, o int").repartition(5)
    got = conv.positions(df, "k", "o", "at", 64).collect()
    for key in ("hot", "a", "b"):
        order = sorted((r.o, r["at"]) for r in got if r.k == key)
        assert [at for _, at in order] == list(range(len(order)))
    assert len(got) == len(rows)


def test_positions_by_times(spark):
    """A session with most rows is numbered by many tasks; null sessions and repeated times have positions too."""
    start = datetime(2024, 1, 1)
    rows = [("hot", start + timedelta(seconds=i * i)) for i in range(4000)] + [("a", start), ("b", start), ("b", start), (None, start)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o timestamp_ntz").repartition(5)
    got = conv.positions(df, "k", "o", "at").withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(rows)
    for key in ("hot", "a", "b", None):
        order = sorted((r.o, r["at"]) for r in got if r.k == key)
        assert sorted(at for _, at in order) == list(range(len(order))) and [o for o, _ in sorted(order, key=lambda x: x[1])] == [o for o, _ in order]
    counts = df.repartitionByRange("k", "o").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in counts) < 3 * sorted(r["count"] for r in counts)[len(counts) // 2]


def test_rewriting(spark):
    df = spark.createDataFrame([("a", 0, "user", "hi", None), ("a", 1, "assistant", "yes", None), ("a", 2, "user", "and?", None)], M)
    turns = conv.rewrite_request(conv.rewrite_context(df)).orderBy("seq").collect()
    assert [t.context for t in turns] == ["", "user: hi\nassistant: yes\n"]
    assert turns[0].request is None
    assert turns[1].request == "CONVERSATION HISTORY:\nuser: hi\nassistant: yes\n\n\nFOLLOW-UP: and?"
    assert [(r.seq, r.request) for r in rewrite_requests(df).collect()] == [(2, turns[1].request)]


def test_merging_rewrites(spark):
    rows = [("a", 0, "first", "ignored"), ("a", 2, "m", None), ("a", 4, "m", "  x \n"), ("a", 6, "m", "  "), ("a", 8, "m", "-")]
    turns = spark.createDataFrame([(s, q, m, "user: x\n" if q else "") for s, q, m, _ in rows],
                                  "session_id string, seq int, content string, context string")
    rewrites = spark.createDataFrame([(s, q, w) for s, q, _, w in rows[:-1]], "session_id string, seq int, rewritten string")
    got = conv.merge_rewrites(turns, rewrites, ["session_id", "seq"]).orderBy("seq").collect()
    assert [r.search_text for r in got] == ["first", "m", "x", "", "m"]


def test_assigned_sessions_are_stable(spark):
    df = spark.createDataFrame([("r1", None), ("r2", ""), ("r3", "s")], "request_id string, session_id string")
    one, two = (sorted(map(tuple, conv.assign_sessions(df).collect())) for _ in range(2))
    assert one == two and one[2] == ("r3", "s") and len({s for _, s in one}) == 3 and all(s for _, s in one)


# Two sessions with two turns each: the first turns find no source, the second two and one.
TURNS = [
    ("t1", "boats", 0, "Good morning", 0, []),
    ("t2", "boats", 1, "Which knot holds a sail?", 2, [
        ("k-7", "Knots", "kb/knots.md", "A bowline does not slip", ".md", 3, 0.21),
        ("k-9", "Sails", "kb/sails.md", "Reef early", ".md", 0, 0.34)]),
    ("t3", "bread", 0, "Is anybody there?", 0, []),
    ("t4", "bread", 1, "How long does rye rise?", 2, [("r-1", "Rye", "kb/rye.md", "Overnight", ".md", 1, 0.4)]),
]


def test_chat_turns(spark):
    """Four turns in two sessions, answered one round after the other."""
    at = datetime(2024, 1, 1)
    logged = M + ", turn_id string"
    log = spark.createDataFrame([], logged)
    for round_no in (0, 1):
        now = [t for t in TURNS if t[2] == round_no]
        turns = spark.createDataFrame(
            [(t, s, o, m, at) for t, s, o, m, _, _ in now],
            "turn_id string, session_id string, turn_order int, message string, asked_at timestamp_ntz")
        asked = turns.join(log.groupBy("session_id").agg((F.max("seq") + 1).alias("n")), "session_id", "left").select(
            "turn_id", "session_id", F.coalesce("n", F.lit(0)).alias("seq"), F.lit("user").alias("role"),
            F.col("message").alias("content"), F.col("asked_at").alias("timestamp"), F.lit(True).alias("new"))
        both = log.unionByName(asked, allowMissingColumns=True)
        past = {r.turn_id: len(r.history) for r in conv.with_history(both).filter("new").collect()}
        rows = [(t, i, *x) for t, *_, s in now for i, x in enumerate(s, 1)]
        sources = spark.createDataFrame(rows, SOURCES)
        answers = spark.createDataFrame(
            [(t, f"{past[t]} before, {len(s)} sources: {m}", at) for t, _, _, m, _, s in now],
            "turn_id string, answer string, answered_at timestamp_ntz")
        for r in conv.responses(turns, sources, answers).collect():
            _, name, _, message, history, expected = next(t for t in TURNS if t[0] == r.turn_id)
            assert r.response == f"{history} before, {len(expected)} sources: {message}"
            assert r.session_id == name and r.retrieval_used == bool(expected)
            assert [tuple(s) for s in r.sources] == expected
        log = spark.createDataFrame(conv.commit_turns(log, turns, answers).collect(), logged)
        assert conv.commit_turns(log, turns, answers).count() == log.count(), "a rerun adds nothing"
    a = log.filter("session_id = 'boats'").orderBy("seq").collect()
    assert [m.role for m in a] == ["user", "assistant", "user", "assistant"] and [m.seq for m in a] == [0, 1, 2, 3]
    assert (a[0].content, a[2].content) == (TURNS[0][3], TURNS[1][3]) and a[0].timestamp == at


def test_unanswered_turns_leave_no_trace(spark):
    log = spark.createDataFrame(session("s", 2), M)
    turns = spark.createDataFrame([("1", "s", 3, "x", None), ("2", "s", 9, "y", None), ("3", "n", 0, "z", None)],
                                  "turn_id string, session_id string, turn_order int, message string, asked_at timestamp_ntz")
    answers = spark.createDataFrame([("1", None, None), ("2", "ok", None)], "turn_id string, answer string, answered_at timestamp_ntz")
    new = conv.new_messages(log, turns, answers).orderBy("seq").collect()
    assert [(m.session_id, m.seq, m.role, m.content) for m in new] == [("s", 2, "user", "y"), ("s", 3, "assistant", "ok")]


def test_unknown_session_has_a_row_without_message(spark):
    log = spark.createDataFrame(session("s", 2), M)
    asked = spark.createDataFrame([("s",), ("u",), ("s",)], "session_id string")
    assert sorted((r.session_id, r.seq) for r in conv.history(log, asked).collect() if r.seq is not None) == [("s", 0), ("s", 1)]
    assert [r.session_id for r in conv.history(log, asked).collect() if r.seq is None] == ["u"]


def test_prompt_parts(spark):
    sources = spark.createDataFrame([
        ("q", 2, "i2", "", "p2", "s2", None, None, None), ("q", 1, "i1", "t1", "", "s1", None, None, None),
        ("q", 3, "i3", None, None, "s3", None, None, None)], SOURCES)
    headings = [r[0] for r in sources.orderBy("rank").select(source_heading()).collect()]
    assert headings == ["[S1] t1", "[S2] p2", "[S3] i3"]
    block = retrieval_block(sources, ["H1", "H2"]).first().block
    assert block == "H1\nH2\n[S1] t1\ns1\n[S2] p2\nPath: p2\ns2\n[S3] i3\ns3"
    df = spark.createDataFrame([("B", "x"), ("B", ""), ("B", None)], "base string, block string")
    assert [r[0] for r in df.select(system_text(F.col("base"), F.col("block"))).collect()] == ["B\n\nx", "B", "B"]
    turns = spark.createDataFrame(session("s", 3), M).filter("seq < 3")
    asked = conv.with_history(turns).select(F.lit("q").alias("query_id"), "content", "history", "seq").filter("seq = 2").drop("seq")
    as_of = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    request = model_requests(asked, sources, base_prompt("Now {as_of}", as_of), ["H1", "H2"]).first()
    assert request.system[0].text == f"Now 2024-01-02 03:04:05\n\n{block}"
    assert [(m.role, m.content[0].text) for m in request.messages] == [("user", "s0"), ("assistant", "s1"), ("user", "s2")]
    assert tuple(request.inferenceConfig) == (2000, 0.7, 0.9)


def test_replay_uses_rewrites_for_search_only(spark):
    from corpusflow.operators.embedding import hashing_embedder
    from corpusflow.plans.ingest import embed_documents

    docs = spark.createDataFrame([("cats.md", "cats purr"), ("tax.md", "income tax")], "filename string, content string")
    log = spark.createDataFrame([("s", 0, "user", "tax", None), ("s", 1, "assistant", "yes", None), ("s", 2, "user", "and they?", None)], M)
    rewrites = spark.createDataFrame([("s", 2, " cats purr ")], "session_id string, seq int, rewritten string")
    e = hashing_embedder(128)
    requests, sources = replay(log, embed_documents(docs, e), F.lit("B"), rewrites, e, return_n=1, dim=128)
    assert {r.query_id: r.title for r in sources.collect()} == {"s#0": "tax", "s#2": "cats"}
    second = {r.query_id: r for r in requests.collect()}["s#2"]
    assert second.messages[-1].content[0].text == "and they?" and "[S1] cats" in second.system[0].text
