import pytest

from corpusflow.sources import commits, message_log

M = "session_id string, seq int, role string, content string, timestamp timestamp_ntz"
T = "turn_id string, session_id string, turn_order int, message string, asked_at timestamp_ntz"
A = "turn_id string, answer string, answered_at timestamp_ntz"


def turn(spark, *ids, session="s"):
    turns = spark.createDataFrame([(t, session, i, f"ask {t}", None) for i, t in enumerate(ids)], T)
    return turns, spark.createDataFrame([(t, f"say {t}", None) for t in ids], A)


def log(spark, path, session="s"):
    rows = message_log.read_log(spark, path).filter(f"session_id = '{session}'").orderBy("seq", "content").collect()
    return [(r.seq, r.content) for r in rows]


def test_two_writers_give_unique_positions_without_gaps(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    message_log.append_messages(spark, path, spark.createDataFrame([("s", 0, "user", "x", None), ("t", 5, "user", "y", None)], M))
    seen = message_log.current_log(spark, path)
    message_log.commit_turns(spark, path, *turn(spark, "a"))
    with pytest.raises(commits.CommitConflict):
        message_log._commit(spark, path, seen._replace(number=seen.number + 1))
    real, stale = message_log.current_log, [seen]
    monkeypatch.setattr(message_log, "current_log", lambda *a: stale.pop() if stale else real(*a))
    message_log.commit_turns(spark, path, *turn(spark, "b", "c"))
    expected = ["x", "ask a", "say a", "ask b", "say b", "ask c", "say c"]
    assert log(spark, path) == list(enumerate(expected)) and log(spark, path, "t") == [(5, "y")]


def test_a_turn_is_committed_once(spark, tmp_path):
    path = str(tmp_path / "log")
    for ids in (("a",), ("a",), ("a", "b"), ("b",)):
        message_log.commit_turns(spark, path, *turn(spark, *ids))
    assert log(spark, path) == list(enumerate(["ask a", "say a", "ask b", "say b"]))
    message_log.commit_turns(spark, path, *turn(spark, "n", session="new"))
    assert log(spark, path, "new") == [(0, "ask n"), (1, "say n")]


def test_a_batch_of_a_stream_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    for number in (0, 1, 1, 0, 2):
        rows = spark.createDataFrame([("s", number, "user", str(number), None)], M)
        message_log.append_messages(spark, path, rows, stream="in", batch=number)
    assert log(spark, path) == [(0, "0"), (1, "1"), (2, "2")]


def test_runs_are_merged_by_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(message_log, "FAN", 3)
    path = str(tmp_path / "log")
    for i in range(10):
        rows = spark.createDataFrame([(f"s{i % 2}", i, "user", str(i), None)], M)
        message_log.append_messages(spark, path, rows, buckets=4)
    now = message_log.current_log(spark, path)
    assert sorted(r.level for r in now.runs) == [0, 2] and now.buckets == 4
    assert log(spark, path, "s0") == [(i, str(i)) for i in range(0, 10, 2)]
    one = message_log.session(message_log.read_log(spark, path), now, "s1")
    assert sorted(r.seq for r in one.collect()) == [1, 3, 5, 7, 9]
    plan = [x for x in one._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x]
    assert any("bucket" in x.split("PartitionFilters: ")[1].split("]")[0] for x in plan)


def test_an_empty_log(spark, tmp_path):
    assert message_log.read_log(spark, str(tmp_path / "none")).count() == 0
