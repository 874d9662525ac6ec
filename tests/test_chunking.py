import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.chunking import chunk_count, chunk_text, ingest_report, with_chunk_metadata
from corpusflow.operators.embedding import batch_embedder, embed, hashing_embedder
from corpusflow.plans.ingest import chunk_documents


def docs_of(spark, contents):
    return spark.createDataFrame([(f"f{i}.md", c) for i, c in enumerate(contents)], "filename string, content string")


def windows(text, size, overlap):
    """A further chunk begins wherever the one a step earlier ends before the text does."""
    step = size - overlap
    return [text[s : s + size] for s in range(0, len(text), step) if s == 0 or s - step + size < len(text)]


@pytest.mark.parametrize("size,overlap", [(10, 3), (10, 0), (7, 6), (1, 0)])
def test_chunks_match_a_plain_loop(spark, size, overlap):
    rng = random.Random(size)
    lengths = [0, 1, 9, 10, 11, 17, 18, 24, 25, 500, 2000]
    texts = ["".join(rng.choices("abcdeä😀\n €", k=n)) for n in lengths]
    got = chunk_text(docs_of(spark, texts), size=size, overlap=overlap).collect()
    for i, text in enumerate(texts):
        mine = sorted((r.chunk_index, r.chunk_text) for r in got if r.filename == f"f{i}.md")
        assert mine == list(enumerate(windows(text, size, overlap)))
    counts = docs_of(spark, texts).select(chunk_count(F.length("content"), size, overlap)).collect()
    assert [c[0] for c in counts] == [len(windows(t, size, overlap)) for t in texts]


def test_null_text_has_no_chunk(spark):
    assert chunk_text(docs_of(spark, [None, "x"])).count() == 1


def test_overlap_must_be_smaller_than_size(spark):
    for size, overlap in [(10, 10), (10, 11), (0, 0), (10, -1)]:
        with pytest.raises(ValueError):
            chunk_text(docs_of(spark, ["x"]), size=size, overlap=overlap)


def test_corpus_shape(spark):
    """Lengths of the five-file corpus and their chunk counts at the default sizes."""
    lengths = {4562: 4, 4253: 4, 4587: 4, 3011: 3, 3879: 3}
    docs = docs_of(spark, ["ü" * n for n in lengths])
    report = {r.filename: (r.chunks_indexed, r.status) for r in ingest_report(docs, chunk_documents(docs)).collect()}
    assert report == {f"f{i}.md": (n, "success") for i, n in enumerate(lengths.values())}


def test_empty_file_is_reported(spark):
    docs = docs_of(spark, [""])
    assert [tuple(r) for r in ingest_report(docs, chunk_documents(docs)).collect()] == [("f0.md", 0, "success")]


def test_metadata(spark):
    df = spark.createDataFrame([("a.b.md", 2, "t"), (".md", 0, "u")], "filename string, chunk_index int, chunk_text string")
    rows = {r.filename: r for r in with_chunk_metadata(df).collect()}
    a = rows["a.b.md"]
    assert (a.key, a.source_path, a.title, a.doc_type, a.chunk_index) == ("a.b.md_2", "api_upload/a.b.md", "a.b", ".md", 2)
    assert rows[".md"].title == ""


def test_hashing_embedder(spark):
    df = spark.createDataFrame([("a b a",), ("  ",), (None,), ("A  b\ta",)], "t string")
    rows = [r.embedding for r in embed(df, "t", hashing_embedder(32)).collect()]
    assert rows[1] is None and rows[2] is None and rows[0] == rows[3] and len(rows[0]) == 32
    assert abs(sum(x * x for x in rows[0]) - 1) < 1e-6 and max(rows[0]) == pytest.approx(2 / 5**0.5)


def test_user_model_loads_once_per_task(spark):
    def load():
        calls = []

        def model(texts):
            calls.append(1)
            return [[float(len(t)), float(len(calls))] for t in texts]

        return model

    df = spark.range(25_000, numPartitions=1).select(F.lit("abc").alias("t"))
    got = embed(df, "t", batch_embedder(load)).select(F.max(F.col("embedding")[1]), F.count("*")).first()
    assert got[0] == 3.0 and got[1] == 25_000


def test_failing_model_gives_no_vectors_on_request(spark):
    def load():
        def model(texts):
            raise OSError("no service")

        return model

    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r.embedding for r in embed(df, "t", batch_embedder(load, on_error="null")).collect()] == [None, None]
    with pytest.raises(Exception, match="no service"):
        embed(df, "t", batch_embedder(load)).collect()
    with pytest.raises(ValueError):
        batch_embedder(load, on_error="skip")


def test_model_runs_once_per_row_under_a_filter(spark):
    df = embed(spark.createDataFrame([("a",)], "t string"), "t", hashing_embedder(4)).filter("size(embedding) = 4")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
