import io
import json

import pytest
from pyspark.sql import functions as F

from corpusflow.sources import transcript_files as files
from corpusflow.sources.transcripts import read_transcripts

M = "session_id string, seq int, role string, content string, timestamp timestamp_ntz"


def frame(spark, rows):
    df = spark.createDataFrame([(s, i, r, c) for s, i, r, c in rows], "session_id string, seq int, role string, content string")
    return df.withColumn("timestamp", F.to_timestamp_ntz(F.lit("2024-01-02T03:04:05.000006")))


def said(df):
    return sorted((r.session_id, r.seq, r.role, r.content) for r in df.collect())


def test_files_are_what_the_session_says(spark, tmp_path):
    rows = [(s, i, "user", f'{s} "{i}"\n é😀') for s in ("s 1+ü%20", "b", "c.d") for i in range(5)]
    files.write_transcript_files(frame(spark, rows).repartition(4), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir() if p.name[0] not in "._") == ["b.json", "c.d.json", "s 1+ü%20.json"]
    entry = [{"role": r, "content": c, "timestamp": "2024-01-02T03:04:05.000006"} for s, i, r, c in rows if s == "b"]
    assert (tmp_path / "b.json").read_text() == json.dumps(entry, indent=2)
    assert said(files.read_transcript_files(spark, str(tmp_path))) == sorted(rows)
    assert read_transcripts(spark, str(tmp_path)).exceptAll(files.read_transcript_files(spark, str(tmp_path), 3)).isEmpty()


def test_a_later_write_replaces_its_sessions(spark, tmp_path):
    files.write_transcript_files(frame(spark, [("a", i, "user", "old") for i in range(4)] + [("b", 0, "user", "b")]), str(tmp_path))
    files.write_transcript_files(frame(spark, [("a", 0, "user", "new")]), str(tmp_path))
    assert said(files.read_transcript_files(spark, str(tmp_path))) == [("a", 0, "user", "new"), ("b", 0, "user", "b")]


def test_a_long_session_is_one_file(spark, tmp_path):
    m = spark.range(100_000).select(
        F.when(F.col("id") % 100 < 99, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 1000)).alias("session_id"),
        F.col("id").cast("int").alias("seq"), F.lit("user").alias("role"), F.col("id").cast("string").alias("content"),
        F.lit(None).cast("timestamp_ntz").alias("timestamp"))
    files.write_transcript_files(m, str(tmp_path))
    got = files.read_transcript_files(spark, str(tmp_path)).filter("session_id = 'hot'").orderBy("seq").collect()
    assert [r.content for r in got] == [str(i) for i in range(100_000) if i % 100 < 99] and got[-1].seq == len(got) - 1


def test_nothing_changes_before_the_commit_and_a_cut_move_is_finished(spark, tmp_path, monkeypatch):
    files.write_transcript_files(frame(spark, [("a", 0, "user", "old")]), str(tmp_path))
    with pytest.raises(Exception):
        files.write_transcript_files(frame(spark, [("a", 0, "user", "bad"), ("b/c", 0, "user", "bad")]), str(tmp_path))
    assert said(files.read_transcript_files(spark, str(tmp_path))) == [("a", 0, "user", "old")]
    monkeypatch.setattr(files, "publish", lambda *a: None)
    files.write_transcript_files(frame(spark, [("a", 0, "user", "new"), ("d", 0, "user", "new")]), str(tmp_path))
    monkeypatch.undo()
    assert json.loads((tmp_path / "a.json").read_text())[0]["content"] == "old"
    assert said(files.read_transcript_files(spark, str(tmp_path))) == [("a", 0, "user", "new"), ("d", 0, "user", "new")]


@pytest.mark.parametrize("text", ["[]", "[ ]\n", '[{"a": "]"}]', '[{"a": 1},\n {"b": "é"}]', '[{"a": [1, {"b": 2}]}, {}]'])
def test_entries(text, monkeypatch):
    for chunk in (1, 2, 7, 100):
        monkeypatch.setattr(files, "_CHUNK", chunk)
        assert list(files.entries(io.BytesIO(text.encode()))) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{}", "[", "[{", '[{"a": 1}', "[1]", '[{"a": 1} {"b": 2}]', "[] x", "[,]"])
def test_malformed(text):
    with pytest.raises(ValueError):
        list(files.entries(io.BytesIO(text.encode())))


def test_empty_tables(spark, tmp_path):
    files.write_transcript_files(spark.createDataFrame([], M), str(tmp_path / "x"))
    assert files.read_transcript_files(spark, str(tmp_path / "x")).count() == 0
    assert files.read_transcript_files(spark, str(tmp_path / "none")).count() == 0
