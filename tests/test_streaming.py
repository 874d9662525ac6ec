import random

from pyspark.sql import functions as F

from corpusflow.catalog import queries
from corpusflow.operators.conversation import with_history
from corpusflow.operators.embedding import embed, hashing_embedder
from corpusflow.plans.ingest import embed_documents, ingest
from corpusflow.plans.retrieve import retrieve
from corpusflow.sources import index, message_log
from corpusflow.sources.markdown import read_markdown, stream_files, stream_markdown
from corpusflow.streaming import jobs

E = hashing_embedder(32)


def test_ingest_stream_ends_like_the_batch_run(spark, tmp_path):
    source, path = tmp_path / "kb", str(tmp_path / "index")
    (source / "sub").mkdir(parents=True)
    run = lambda: jobs.stream_ingest(stream_markdown(spark, str(source))[0], path, str(tmp_path / "progress"), E).awaitTermination()
    (source / "a.md").write_text("alpha beta " * 400)
    (source / "x.txt").write_text("no")
    run()
    index.compact(spark, path, buckets=4)
    (source / "b.md").write_text("gamma")
    (source / "sub" / "b.md").write_text("delta")
    (source / "latin.md").write_bytes("ä".encode("latin-1"))
    run()
    run()
    index.compact(spark, path, buckets=4)
    batch = embed_documents(read_markdown(spark, str(source))[0], E)
    columns = ["key", "filename", "source_path", "title", "doc_type", "chunk_index", "chunk_text", "embedding"]
    got = sorted(map(tuple, index.read_index(spark, path).select(columns).collect()))
    assert got == sorted(map(tuple, batch.select(columns).collect())) and len(got) == 6
    rejects = stream_markdown(spark, str(source))[1]
    rejects.writeStream.format("parquet").option("path", str(tmp_path / "rejects")).option(
        "checkpointLocation", str(tmp_path / "rejected")).trigger(availableNow=True).start().awaitTermination()
    same = read_markdown(spark, str(source))[1].collect()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "rejects")).collect())) == sorted(map(tuple, same))


def test_outcomes_of_streamed_files(spark, tmp_path):
    """Documents and rejects of one stream; the report equals that of a batch ingest of the same files."""
    source, path = tmp_path / "kb", str(tmp_path / "index")
    source.mkdir()
    run = lambda: jobs.stream_ingest(stream_files(spark, str(source)), path, str(tmp_path / "progress"), E).awaitTermination()
    (source / "a.md").write_text("alpha beta " * 400)
    (source / "x.txt").write_text("no")
    run()
    index.compact(spark, path, buckets=4)
    (source / "b.md").write_text("gamma")
    (source / "latin.md").write_bytes("ä".encode("latin-1"))
    run()
    got = {r.filename: (r.chunks_indexed, r.status, r.reason, r.searchable) for r in jobs.ingest_outcomes(spark, path).collect()}
    assert got == {
        "a.md": (4, "success", None, True), "b.md": (1, "success", None, False),
        "x.txt": (None, "rejected", "not a .md file", False), "latin.md": (None, "rejected", "not valid UTF-8", False),
    }
    index.compact(spark, path)
    assert {r.filename for r in jobs.ingest_outcomes(spark, path).filter("searchable").collect()} == {"a.md", "b.md"}
    report, rejects = ingest(spark, str(source), str(tmp_path / "batch"), 1, E)
    assert {r.filename: r.chunks_indexed for r in report.collect()} == {"a.md": 4, "b.md": 1}
    assert {r.filename: r.reason for r in rejects.collect()} == {f: o[2] for f, o in got.items() if o[1] == "rejected"}


def test_history_stream_equals_batch(spark, tmp_path):
    """Sessions arrive over several batches, shuffled inside each; some messages come late, positions have gaps."""
    schema = "session_id string, seq int, role string, content string"
    rng = random.Random(4)
    rows = [(s, i * (1 if s == "hot" else 2000), "user" if i % 2 == 0 else "assistant", f"{s}{i}")
            for s, n in [("hot", 300), ("b", 26), ("c", 1), ("d", 60)] for i in range(n)]
    source = tmp_path / "in"
    at = {r[:2]: min(5, r[1] // (50 if r[0] == "hot" else 100_000)) if rng.random() < 0.8 else rng.randrange(6) for r in rows}
    for number in range(6):
        part = [r for r in rows if at[r[:2]] == number]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    path, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for _ in range(2):
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(source))
        jobs.stream_history(arriving, path, progress).awaitTermination()
    got = {(r.session_id, r.seq): r.contents for r in jobs.read_histories(spark, path).collect()}
    batch = with_history(spark.createDataFrame(rows, schema)).collect()
    assert got == {(r.session_id, r.seq): [m.content[0].text for m in r.history] for r in batch}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    schema = "session_id string, seq int, role string, content string"
    spark.createDataFrame([("a", i, "user", f"{i}") for i in range(6)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    path, progress = str(tmp_path / "out"), tmp_path / "progress"
    for _ in range(2):
        arriving = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_history(arriving, path, str(progress)).awaitTermination()
        assert {(r.seq, len(r.contents)) for r in jobs.read_histories(spark, path).collect()} == {(i, i) for i in range(6)}
        for done in [*(progress / "commits").glob("0"), *(progress / "commits").glob(".0.crc")]:
            done.unlink()  # as if the driver had been lost before the batch was marked
    assert message_log.read_log(spark, f"{path}/messages").count() == 6


def test_retrieve_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(f"{i}.md", f"note {i} about {w}") for i, w in enumerate("cats dogs tax rain".split())],
                                 "filename string, content string")
    vectors = embed_documents(docs, E)
    asked = spark.createDataFrame([(str(i), w) for i, w in enumerate(["about cats", "tax", "", "rain dogs"])], "query_id string, query string")
    for part in range(2):
        asked.filter(F.col("query_id").cast("int") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.stream_retrieve(embed(arriving, "query", E), vectors, str(tmp_path / "out"), str(tmp_path / "progress"), dim=32).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, retrieve(embed(asked, "query", E), vectors, dim=32).collect()))


def test_a_streamed_table_may_be_a_file_or_a_folder_of_files(spark, tmp_path):
    rows = [(s, t, "user" if t % 2 == 0 else "assistant", f"{s}-{t}") for s in range(9) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.repartition(3).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    (tmp_path / "file").mkdir()
    table.toPandas().to_parquet(tmp_path / "file" / "conversations.parquet")
    for kind in ("folder", "file"):
        got = queries.stream_history(spark, str(tmp_path / kind)).collect()
        assert sorted((r.session_id, r.seq, r.n) for r in got) == [(s, t, t) for s in range(9) for t in (0, 2)], kind
        assert {r.history for r in got if r.session_id == 4} == {"", "user=4-0|assistant=4-1"}


def test_histories_before_the_first_batch(spark, tmp_path):
    assert jobs.read_histories(spark, str(tmp_path / "none")).collect() == []
