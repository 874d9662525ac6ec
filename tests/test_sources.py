import json
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.embedding import hashing_embedder
from corpusflow.operators.knn import knn
from corpusflow.plans.ingest import embed_documents, ingest
from corpusflow.schemas import VECTORS
from corpusflow.sources import files, index, transcripts
from corpusflow.sources.markdown import read_markdown, scan_markdown

E = hashing_embedder(16)


def test_markdown_files(spark, tmp_path):
    text = "﻿# Größe\r\n| m² | € |\n"
    (tmp_path / "a.md").write_bytes(text.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "empty ü%20+.md").write_bytes(b"")
    (tmp_path / "sub" / "a.md").write_text("other")
    (tmp_path / "a b+%20.md").write_text("b")
    (tmp_path / "latin.md").write_bytes("ä".encode("latin-1"))
    (tmp_path / "B.MD").write_text("x")
    (tmp_path / "c.txt").write_text("x")
    docs, rejects = read_markdown(spark, str(tmp_path))
    assert {r.filename: r.content for r in docs.collect()} == {
        "a.md": text, "sub/empty ü%20+.md": "", "a b+%20.md": "b", "sub/a.md": "other",
    }
    assert {r.filename: r.reason for r in rejects.collect()} == {
        "latin.md": "not valid UTF-8", "B.MD": "not a .md file", "c.txt": "not a .md file",
    }


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """Nested and hidden folders, many small files and an empty one; a folder that is not there."""
    for i in range(120):
        (tmp_path / f"d{i % 3}" / "e" / f"f{i % 2}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"d{i % 3}" / "e" / f"f{i % 2}" / f"{i}.md").write_text("x" * i)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "a.md").write_text("no")
    (tmp_path / ".b.md").write_text("no")
    (tmp_path / "top.md").write_text("top")
    listed = files.list_files(spark, str(tmp_path))
    sizes = {r.path: r["size"] for r in listed.collect()}
    assert len(sizes) == 121 and sizes["top.md"] == 3 and sizes["d0/e/f0/0.md"] == 0
    read = files.read_files(spark, str(tmp_path), listed)
    assert {r.path: len(r.content) for r in read.collect()} == sizes and read.rdd.getNumPartitions() > 1
    assert files.list_files(spark, str(tmp_path / "none")).count() == 0
    docs, rejects = read_markdown(spark, str(tmp_path / "none"))
    assert docs.count() == 0 and rejects.count() == 0
    scanned = {r.filename for r in scan_markdown(spark, str(tmp_path))[0].collect()}
    assert scanned == set(sizes) - {"d0/e/f0/0.md"}


def test_latest_takes_the_highest_version(spark):
    rows = [("k", "old", 1), ("k", "new", 3), ("k", "mid", 2), ("j", "x", 1), ("j", "x", 1)]
    df = spark.createDataFrame(rows, "key string, chunk_text string, version bigint")
    assert sorted(map(tuple, index.latest(df).collect())) == [("j", "x", 1), ("k", "new", 3)]


@pytest.mark.parametrize("replace,keys", [(False, ["f.md_0", "f.md_1", "f.md_2", "g.md_0"]), (True, ["f.md_0", "f.md_1", "g.md_0"])])
def test_a_shorter_document(spark, replace, keys):
    schema = "key string, filename string, version bigint"
    current = spark.createDataFrame([(f"f.md_{i}", "f.md", 1) for i in range(3)] + [("g.md_0", "g.md", 1)], schema)
    incoming = spark.createDataFrame([(f"f.md_{i}", "f.md", 2) for i in range(2)], schema)
    got = {r.key: r.version for r in index.upsert(current, incoming, replace).collect()}
    assert sorted(got) == keys and got["f.md_0"] == 2 and got["g.md_0"] == 1


def test_ingest_twice(spark, tmp_path):
    source, path = tmp_path / "kb", str(tmp_path / "index")
    source.mkdir()
    (source / "a.md").write_text("word " * 700)
    (source / "b.md").write_text("")
    (source / "c.txt").write_text("no")
    report, rejects = ingest(spark, str(source), path, 1, E)
    assert {r.filename: r.chunks_indexed for r in report.collect()} == {"a.md": 3, "b.md": 0}
    assert rejects.count() == 1
    (source / "a.md").write_text("shorter text")
    before = index.read_index(spark, path)
    ingest(spark, str(source), path, 2, E)
    now = {r.key: r.version for r in index.read_index(spark, path).collect()}
    assert now == {"a.md_0": 2, "a.md_1": 1, "a.md_2": 1}
    assert {r.version for r in before.collect()} == {1}, "a reader keeps the snapshot it opened"


def put_rows(spark, *rows):
    """(key, version) rows as vectors; the file is the part before the underscore."""
    return spark.createDataFrame([(k, k.split("_")[0], v) for k, v in rows], "key string, filename string, version bigint").select(
        *[F.col(f.name) if f.name in ("key", "filename", "version") else F.lit(None).cast(f.dataType).alias(f.name)
          for f in VECTORS.fields])


def state(spark, path):
    return {r.key: r.version for r in index.read_index(spark, path).collect()}


def test_folding_never_brings_old_rows_back(spark, tmp_path):
    path = str(tmp_path / "i")
    index.append_log(put_rows(spark, ("a_0", 1), ("a_1", 1), ("a_2", 1)), path, "s", 0)
    assert index.compact(spark, path, True, buckets=2) == 1
    index.put(spark, path, put_rows(spark, ("a_0", 9), ("a_1", 9)), replace_document=True)
    assert state(spark, path) == {"a_0": 9, "a_1": 9}
    before = index.current_snapshot(spark, path)
    assert index.compact(spark, path, True) == before.snapshot, "nothing to fold"
    index.append_log(put_rows(spark, ("a_0", 3), ("b_0", 1), ("b_1", 1)), path, "s", 1)
    index.append_log(put_rows(spark, ("b_0", 2)), path, "other", 0)
    assert index.compact(spark, path, True) == before.snapshot + 1
    assert state(spark, path) == {"a_0": 9, "a_1": 9, "b_0": 2}
    last = index.current_snapshot(spark, path)
    assert last.folded == {"s": 1, "other": 0} and last.buckets == 2


def test_an_unfinished_batch_is_not_folded(spark, tmp_path):
    path = str(tmp_path / "i")
    index.append_log(put_rows(spark, ("a_0", 1)), path, "s", 0)
    put_rows(spark, ("b_0", 1)).write.parquet(f"{path}/log/stream=s/batch=1")
    index.compact(spark, path, buckets=2)
    assert state(spark, path) == {"a_0": 1}
    index.append_log(put_rows(spark, ("b_0", 1)), path, "s", 1)
    index.compact(spark, path)
    assert state(spark, path) == {"a_0": 1, "b_0": 1}


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """Both start from the same snapshot: the second's commit is refused, it puts again."""
    path = str(tmp_path / "i")
    index.put(spark, path, put_rows(spark, ("a_0", 1)), buckets=2)
    seen = index.current_snapshot(spark, path)
    index.put(spark, path, put_rows(spark, ("b_0", 1)))
    with pytest.raises(index.CommitConflict):
        index.write_snapshot(put_rows(spark, ("c_0", 1)), path, 2, seen)
    real, stale = index.current_snapshot, [seen]
    number = real(spark, path).snapshot
    monkeypatch.setattr(index, "current_snapshot", lambda *a: stale.pop() if stale else real(*a))
    assert index.put(spark, path, put_rows(spark, ("c_0", 1))) == number + 1
    assert state(spark, path) == {"a_0": 1, "b_0": 1, "c_0": 1}


def test_any_puts_and_folds_give_what_upsert_gives(spark, tmp_path):
    """Random puts with and without replacing documents, folded now and then, against the plain rules."""
    rng, path, model = random.Random(2), str(tmp_path / "i"), {}
    for turn in range(12):
        replace = rng.random() < 0.5
        rows = list({(f"{rng.choice('abcd')}_{rng.randrange(4)}", rng.randrange(1, 5)) for _ in range(rng.randint(1, 6))})
        rows = [max(r for r in rows if r[0] == k) for k in {k for k, _ in rows}]
        of = (lambda k: k[0]) if replace else (lambda k: k)
        put = {g: max(v for k, v in rows if of(k) == g) for g in {of(k) for k, _ in rows}}
        there = {g: max(v for k, v in model.items() if of(k) == g) for g in {of(k) for k in model}}
        new = [(k, v) for k, v in rows if (not replace or v == put[of(k)]) and there.get(of(k), 0) <= v]
        model = {k: v for k, v in model.items() if v > put.get(of(k), 0)} | dict(new)
        index.put(spark, path, put_rows(spark, *rows), replace, buckets=3)
        assert state(spark, path) == model
        if turn % 5 == 4:
            index.fold(spark, path)
            assert state(spark, path) == model and not index.current_snapshot(spark, path).deltas


def sizes(folder):
    return {str(f.relative_to(folder)): f.stat().st_size for f in folder.rglob("*.parquet")}


def test_a_put_writes_one_delta_of_its_own_size(spark, tmp_path):
    one, written = put_rows(spark, ("x_0", 2)), []
    for n in (100, 20_000):
        path = tmp_path / f"i{n}"
        index.put(spark, str(path), put_rows(spark, *((f"d{i}_0", 1) for i in range(n))), buckets=4)
        before = sizes(path)
        index.put(spark, str(path), one)
        new = {f: s for f, s in sizes(path).items() if f not in before}
        assert all(f.startswith("deltas/") for f in new) and sizes(path).keys() >= before.keys()
        written.append(sum(new.values()))
        assert len(index.current_snapshot(spark, str(path)).deltas) == 1
    assert written[0] == written[1]


def test_a_fold_writes_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "i")
    index.put(spark, path, put_rows(spark, *((f"d{i}_0", 1) for i in range(2000))), buckets=16)
    before = index.current_snapshot(spark, path)
    index.put(spark, path, put_rows(spark, ("d7_0", 2)))
    index.fold(spark, path)
    after = index.current_snapshot(spark, path)
    assert len(before.base) == 16 and sum(before.base[b] != after.base[b] for b in before.base) == 1
    assert after.rows == 2000 and state(spark, path)["d7_0"] == 2


def test_buckets_grow_with_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_ROWS", 50)
    path = str(tmp_path / "i")
    for n in (10, 200, 900):
        index.put(spark, path, put_rows(spark, *((f"d{i}_0", 1) for i in range(n))))
        last = index.current_snapshot(spark, path)
        assert last.rows == n and n / last.buckets < 100 and not last.deltas
    assert last.buckets == 16 and len(state(spark, path)) == 900


def test_puts_during_a_fold_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    more = {f"{c}_0": 1 for c in "cdefghi"}
    index.put(spark, path, put_rows(spark, ("a_0", 1), ("b_0", 1), *more.items()), buckets=2)
    index.put(spark, path, put_rows(spark, ("a_0", 2)))
    real = index._write_base

    def slow(*args):
        monkeypatch.setattr(index, "_write_base", real)
        index.put(spark, path, put_rows(spark, ("b_0", 2)))
        return real(*args)

    monkeypatch.setattr(index, "_write_base", slow)
    index.fold(spark, path)
    assert state(spark, path) == {"a_0": 2, "b_0": 2} | more
    assert [d.rows for d in index.current_snapshot(spark, path).deltas] == [1]


def test_a_writer_lost_within_its_commit_blocks_nobody(spark, tmp_path):
    path = tmp_path / "i"
    index.put(spark, str(path), put_rows(spark, ("a_0", 1)), buckets=2)
    number = index.current_snapshot(spark, str(path)).snapshot
    for name in (f"{number + 1:012d}.json", f"_{number + 2:012d}.json-lost"):
        (path / "commits" / name).write_text("")
    assert index.put(spark, str(path), put_rows(spark, ("b_0", 1))) == number + 2
    assert state(spark, str(path)) == {"a_0": 1, "b_0": 1}
    assert index.put(spark, str(path), put_rows(spark, ("c_0", 1))) > number + 2 and len(state(spark, str(path))) == 3


def test_metadata_conditions_reach_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(f"{i:05d}.md", f"text {i}") for i in range(4000)], "filename string, content string")
    path, block = str(tmp_path / "i"), "parquet.block.size"
    spark.conf.set(block, "20000")  # row groups of this small table
    index.put(spark, path, embed_documents(docs, E).withColumn("version", F.lit(1).cast("long")), buckets=1)
    spark.conf.unset(block)
    where = (F.col("source_path") >= "api_upload/00100.md") & (F.col("source_path") < "api_upload/00110.md")
    found = index.read_index(spark, path, where=where)
    plan = found._jdf.queryExecution().executedPlan()
    assert "GreaterThanOrEqual(source_path" in plan.toString() and sorted(r.title for r in found.collect()) == [f"{i:05d}" for i in range(100, 110)]
    assert plan.collectLeaves().head().metrics().apply("numOutputRows").value() < 1000, "other row groups are passed over"
    index.put(spark, path, index.read_index(spark, path).drop("bucket").filter("title = '00105'").withColumn("source_path", F.lit("moved")).withColumn("version", F.lit(2).cast("long")))
    titles = sorted(r.title for r in index.read_index(spark, path, where=where).collect())
    assert titles == [f"{i:05d}" for i in range(100, 110) if i != 105], "a newer row that does not meet the condition hides the older"


def test_rows_fetched_by_key(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(index, "GROUP_BYTES", 20_000)  # row groups of these small tables
    monkeypatch.setattr(index, "BUCKET_ROWS", 1000)
    read = []
    for n in (1000, 8000):
        path = str(tmp_path / f"i{n}")
        docs = spark.createDataFrame([(f"{i:05d}.md", f"text {i} " * 20) for i in range(n)], "filename string, content string")
        index.put(spark, path, embed_documents(docs, E).withColumn("version", F.lit(1).cast("long")))
        vectors, fetch = index.open_index(spark, path)
        all_rows = {r.key: r for r in vectors.select("key", "title", "chunk_text").collect()}
        keys = [*(f"{i:05d}.md_0" for i in range(0, 1000, 50)), "gone", "\uffff"]
        asked = spark.createDataFrame([(k,) for k in keys], "key string")
        found = fetch(asked, ["title", "chunk_text"]).collect()
        assert sorted(found) == sorted(all_rows[k] for k in keys[:-2])
        assert fetch(asked.limit(0), ["title"]).count() == 0
        now = index.current_snapshot(spark, path)
        # Bytes that one key's lookup takes, of what its bucket's files have.
        bucket = vectors.filter("key = '00500.md_0'").first().bucket
        folder = f"{path}/base/run={now.base[bucket]}/bucket={bucket}"
        groups = list(index.find_rows(fs.LocalFileSystem(), folder, ["00500.md_0"], ["key", "chunk_text"]))
        assert sum(rows.num_rows for rows, _ in groups if rows is not None) == 1
        read.append((now.buckets, sum(size for _, size in groups)))
    assert read[1][0] >= 4 * read[0][0] and read[1][1] < 1.5 * read[0][1], read
    # Deltas on top: a newer row, a new row, an older version that is of no use.
    index.put(spark, path, put_rows(spark, ("x_0", 1)))
    changed = vectors.drop("bucket").filter("key in ('00050.md_0', '00100.md_0')")
    changed = changed.withColumn("title", F.lit("new")).withColumn("version", F.when(F.col("key") == "00050.md_0", 2).otherwise(0).cast("long"))
    index.put(spark, path, changed)
    again, fetch = index.open_index(spark, path)
    want = {(r.key, r.title) for r in again.filter(F.col("key").isin("x_0", *keys)).collect()}
    got = fetch(asked.union(spark.createDataFrame([("x_0",)], "key string")), ["title"]).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 21 and ("00050.md_0", "new") in want
    q = again.filter("key = '00150.md_0'").select(F.col("key").alias("query_id"), "embedding")
    plain = knn(q, again, 5, dim=16, metadata=["title", "chunk_text"])
    assert sorted(knn(q, again, 5, dim=16, metadata=["title", "chunk_text"], fetch=fetch).collect()) == sorted(plain.collect())
    assert index.open_index(spark, str(tmp_path / "none"))[1](asked, ["title"]).count() == 0


def test_a_later_export_replaces_its_sessions_only(spark, tmp_path):
    schema = "session_id string, seq int, role string, content string, timestamp timestamp_ntz"
    path = str(tmp_path / "out")
    def rows(name, n, text):
        return [(name, i, "user", text, None) for i in range(n)]
    transcripts.write_transcripts(spark.createDataFrame(rows("s", 5, "old") + rows("t", 2, "t"), schema), path, 2)
    transcripts.write_transcripts(spark.createDataFrame(rows("s", 3, "new"), schema), path)
    got = transcripts.read_written_transcripts(spark, path).select("session_id", "seq", "content").collect()
    assert sorted(map(tuple, got)) == [("s", i, "new") for i in range(3)] + [("t", i, "t") for i in range(2)]


def test_ingest_rejects_vectors_of_another_size(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "a.md").write_text("word")
    report, rejects = ingest(spark, str(tmp_path / "kb"), str(tmp_path / "i"), 1, E, dim=8)
    assert [(r.filename, r.reason) for r in rejects.collect()] == [("a.md", "dimension 16")]
    assert [(r.filename, r.chunks_indexed) for r in report.collect()] == [("a.md", 0)]


def test_search_in_a_stored_index_carries_the_bucket(spark, tmp_path):
    docs = spark.createDataFrame([(f"{i}.md", f"text {i} of many") for i in range(40)], "filename string, content string")
    path = str(tmp_path / "i")
    index.write_snapshot(embed_documents(docs, E).withColumn("version", F.lit(1).cast("long")), path, 8)
    stored = index.read_index(spark, path)
    q = stored.filter("key = '7.md_0'").select(F.col("key").alias("query_id"), "embedding")
    hits = knn(q, stored, 3, dim=16, metadata=["title"])
    assert hits.filter("raw_rank = 1").first().distance == 0.0
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_transcript_files(spark, tmp_path):
    rows = [{"role": "user", "content": "hi ü \"q\"\n", "timestamp": "2024-01-02T03:04:05.000006"},
            {"role": "assistant", "content": "yo", "timestamp": "2024-01-02T03:04:05"}]
    (tmp_path / "s 1+ü%20.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "none.json").write_text("[]")
    got = transcripts.read_transcripts(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(m.session_id, m.seq, m.role, m.content, m.timestamp.isoformat()) for m in got] == [
        ("s 1+ü%20", i, r["role"], r["content"], r["timestamp"]) for i, r in enumerate(rows)
    ]
    parts = transcripts.transcript_json(transcripts.read_transcripts(spark, str(tmp_path)))
    assert [(p.session_id, p.first_seq) for p in parts.collect()] == [("s 1+ü%20", 0)]
    assert [m["content"] for m in json.loads(parts.first().value)] == [r["content"] for r in rows]
    again = transcripts.parse_transcript_json(parts).orderBy("seq").collect()
    assert again == got


def test_malformed_transcript_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception):
        transcripts.read_transcripts(spark, str(tmp_path)).collect()


def test_long_session_is_exported_in_parts(spark):
    m = spark.range(25).select(
        F.lit("s").alias("session_id"), F.col("id").cast("int").alias("seq"), F.lit("user").alias("role"),
        F.col("id").cast("string").alias("content"), F.lit(None).cast("timestamp_ntz").alias("timestamp"))
    parts = transcripts.transcript_json(m, 10)
    assert sorted((p.first_seq, len(json.loads(p.value))) for p in parts.collect()) == [(0, 10), (10, 10), (20, 5)]
    assert [r.content for r in transcripts.parse_transcript_json(parts).orderBy("seq").collect()] == [str(i) for i in range(25)]


def test_message_log_reads_one_bucket_per_session(spark, tmp_path):
    m = spark.range(100).select(
        F.concat(F.lit("s"), F.col("id") % 10).alias("session_id"), F.floor(F.col("id") / 10).cast("int").alias("seq"),
        F.lit("user").alias("role"), F.lit("x").alias("content"), F.lit(None).cast("timestamp_ntz").alias("timestamp"))
    path = str(tmp_path / "log")
    transcripts.append_messages(m.filter("seq < 5"), path)
    transcripts.append_messages(m.filter("seq >= 5"), path, 8)
    one = transcripts.session_messages(transcripts.read_messages(spark, path), "s3")
    assert sorted(r.seq for r in one.collect()) == list(range(10))
    scan = [x for x in one._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x][0]
    assert "bucket" in scan.split("PartitionFilters: ")[1].split("]")[0]


def test_a_large_gain_is_folded_from_the_log(spark, tmp_path, monkeypatch):
    """No second copy of it is written, and whole rows are shuffled once."""
    path, plans = str(tmp_path / "i"), []
    real = index._kept_rows

    def seen(*args):
        plans.append(real(*args))
        return plans[-1]

    monkeypatch.setattr(index, "_kept_rows", seen)
    for batch, replace in ((0, False), (1, True)):
        index.append_log(put_rows(spark, ("a_0", 1 + batch), ("b_0", 1), ("b_1", 1)), path, "s", batch)
        assert index.compact(spark, path, replace, buckets=2) == batch + 1
        assert state(spark, path) == {"a_0": 1 + batch, "b_0": 1, "b_1": 1}
    assert not (tmp_path / "i" / "deltas").exists() and len(plans) == 2
    for plan in plans:
        lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
        assert sum("Exchange" in line for line in lines) == 1


@pytest.mark.parametrize("seed", range(3))
def test_folds_keep_what_readers_see(spark, tmp_path, monkeypatch, seed):
    """Keys, names and versions that are null, come twice or are of several documents."""
    monkeypatch.setattr(index, "MAX_DELTAS", 99)
    monkeypatch.setattr(index, "FOLD_SHARE", 1e9)
    rng, path = random.Random(seed), str(tmp_path / "i")

    def rows(n):
        made = [(rng.choice([None, *"abcdefgh"]), rng.choice([None, "x", "y", "z"]), rng.choice([None, 1, 2, 3]), rng.choice("pq")) for _ in range(n)]
        given = spark.createDataFrame(made, "key string, filename string, version long, chunk_text string")
        return given.select(*(F.col(f.name) if f.name in given.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in VECTORS))

    def seen(frame):
        return sorted(map(str, frame.select(*VECTORS.names).collect()))

    index.write_snapshot(rows(12), path, buckets=2)
    for replace in (False, True, False, True):
        index.put(spark, path, rows(6), replace)
    before = seen(index.read_index(spark, path))
    index.fold(spark, path)
    assert not index.current_snapshot(spark, path).deltas and seen(index.read_index(spark, path)) == before
    for batch, replace in ((0, seed % 2 == 0), (1, True)):
        gain = rows(9)
        index.append_log(gain, path, "s", batch)
        gain = index.read_log(spark, path, {"s": batch - 1}, {"s": batch})
        other = f"{path}-{batch}"
        index.write_snapshot(index.read_index(spark, path), other, buckets=2)
        index.put(spark, other, gain, replace)
        monkeypatch.setattr(index, "FOLD_SHARE", 0)
        index.compact(spark, path, replace)
        monkeypatch.setattr(index, "FOLD_SHARE", 1e9)
        assert not index.current_snapshot(spark, path).deltas and seen(index.read_index(spark, path)) == seen(index.read_index(spark, other))
