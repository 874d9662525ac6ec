from datetime import datetime

from pyspark.sql import functions as F

from corpusflow.operators import conversation as conv
from corpusflow.operators.embedding import hashing_embedder
from corpusflow.plans import chat
from corpusflow.plans.ingest import embed_documents

LOG = "session_id string, seq int, role string, content string, timestamp timestamp_ntz, turn_id string"
REQUESTS = "request_id string, session_id string, turn_order int, message string, asked_at timestamp_ntz"
AT = datetime(2024, 5, 6)


def test_requests_to_log_and_back(spark):
    """A long session with gaps, two open turns in one session, one without a session."""
    rows = [("s", 3 * i, "user" if i % 2 == 0 else "assistant", f"m{i}", None, None) for i in range(25)]
    log = spark.createDataFrame(rows, LOG)
    asked = [("r1", "s", 0, "cats", AT), ("r2", "s", 1, "tax", AT), ("r3", None, 0, "cats", AT), ("r4", "", 0, "dogs", AT)]
    turns = chat.open_turns(spark.createDataFrame(asked, REQUESTS))
    past = {r.turn_id: r for r in chat.with_past(log, turns).collect()}
    for turn in ("r1", "r2"):
        assert [m.content[0].text for m in past[turn].history] == [f"m{i}" for i in range(5, 25)]
        assert past[turn].context == "".join(f"{'user' if i % 2 == 0 else 'assistant'}: m{i}\n" for i in range(20, 25))
    assert past["r3"].history == [] and past["r4"].context == ""
    assert {r.turn_id for r in chat.rewrite_requests(log, turns).collect()} == {"r1", "r2"}

    docs = spark.createDataFrame([("cats.md", "cats purr"), ("tax.md", "income tax")], "filename string, content string")
    e = hashing_embedder(128)
    rewrites = spark.createDataFrame([("r1", " income tax "), ("r3", "income tax")], "turn_id string, rewritten string")
    requests, sources = chat.chat_requests(
        log, turns, embed_documents(docs, e), F.lit("B"), rewrites, e, dim=128, return_n=1, max_distance=0.9)
    assert {r.query_id: r.title for r in sources.collect()} == {"r1": "tax", "r2": "tax", "r3": "cats"}
    by_turn = {r.query_id: r for r in requests.collect()}
    assert len(by_turn) == 4 and by_turn["r1"].messages[-1].content[0].text == "cats"

    answers = spark.createDataFrame([("r1", "a1", AT), ("r3", "a3", AT), ("r4", None, AT)],
                                    "turn_id string, answer string, answered_at timestamp_ntz")
    once, responses = chat.close_turns(log, turns, sources, answers)
    assert {r.turn_id: r.retrieval_used for r in responses.collect()} == {"r1": True, "r3": True}
    kept = spark.createDataFrame(once.collect(), once.schema)
    twice, _ = chat.close_turns(kept, turns, sources, answers)
    assert sorted(map(str, twice.collect())) == sorted(map(str, kept.collect())) and kept.count() == 29
    new = kept.filter("turn_id = 'r1'").orderBy("seq").collect()
    assert [(m.seq, m.role, m.content) for m in new] == [(73, "user", "cats"), (74, "assistant", "a1")]


def test_the_log_is_cut_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([("s", i, "user", "x", None, None) for i in range(50)], LOG).write.parquet(path)
    turns = chat.open_turns(spark.createDataFrame([("r", "s", 0, "m", AT)], REQUESTS))
    plan = chat.with_past(spark.read.schema(LOG).parquet(path), turns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_sources_are_searched_once(spark):
    """The requests and the responses read what the search has written."""
    log = spark.createDataFrame([("s", 0, "user", "m", None, None)], LOG)
    turns = chat.open_turns(spark.createDataFrame([("r1", "s", 0, "cats", AT)], REQUESTS))
    docs = spark.createDataFrame([("cats.md", "cats purr"), ("tax.md", "income tax")], "filename string, content string")
    e = hashing_embedder(128)
    requests, sources = chat.chat_requests(log, turns, embed_documents(docs, e), F.lit("B"), None, e, dim=128)
    _, responses = chat.close_turns(log, turns, sources, spark.createDataFrame([("r1", "a1", AT)], "turn_id string, answer string, answered_at timestamp_ntz"))
    for df in (requests, responses):
        assert "InArrow" not in df._jdf.queryExecution().executedPlan().toString()
    assert [[s.title for s in r.sources] for r in responses.collect()] == [["cats", "tax"]]
    assert "[S1] cats" in requests.first().system[0].text
