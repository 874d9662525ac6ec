from collections import namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import knn as module
from corpusflow.operators.embedding import batch_embedder, embed
from corpusflow.operators.knn import knn

Q = "query_id int, embedding array<float>"
V = "key string, embedding array<float>, title string"


def brute(queries, vectors, k, metric):
    out = {}
    for qid, q in queries:
        q = np.asarray(q, "float32").astype("float64")
        near = []
        for key, v, _ in vectors:
            v = np.asarray(v, "float32").astype("float64")
            if metric == "cosine":
                d = 1 - q @ v / (np.linalg.norm(q) * np.linalg.norm(v))
            else:
                d = np.linalg.norm(q - v)
            near.append((round(float(d), 6) + 0.0, key))
        for rank, (d, key) in enumerate(sorted(near)[:k], 1):
            out[qid, rank] = (key, d)
    return out


def clusters(n, dim=8, seed=3):
    """Groups of vectors, a third of all being exact copies of one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 3
    v = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.3
    v[: n // 3] = v[0]
    return v


def as_dict(df):
    return {(r.query_id, r.raw_rank): (r.key, r.distance) for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("way", ["broadcast", "cells", "small blocks"])
@pytest.mark.parametrize("shift", [0.0, 50.0])
def test_same_as_brute_force(spark, monkeypatch, metric, way, shift):
    if way == "small blocks":
        monkeypatch.setattr(module, "BLOCK_BYTES", 10 * 8 * 8)
    data = clusters(240) + shift
    vectors = [(f"k{i * 7919 % 240}", v.tolist(), f"t{i}") for i, v in enumerate(data)]
    queries = [(i, v.tolist()) for i, v in enumerate(np.vstack([clusters(30, seed=5) + shift, data[:10]]))]
    bound = 50_000 if way == "broadcast" else 0
    got = knn(
        spark.createDataFrame(queries, Q), spark.createDataFrame(vectors, V).repartition(5), 9, metric, dim=data.shape[1],
        max_broadcast_queries=bound, n_cells=8,
    )
    assert as_dict(got) == brute(queries, vectors, 9, metric)


@pytest.mark.parametrize("metric,cut", [("cosine", 0.02), ("euclidean", 0.8), ("euclidean", 0.0), ("cosine", -1.0)])
@pytest.mark.parametrize("bound", [50_000, 0])
def test_cutoff_limits_the_search_and_changes_no_hit(spark, metric, cut, bound):
    data = clusters(240)
    vectors = [(f"k{i}", v.tolist(), "t") for i, v in enumerate(data)]
    queries = [(i, v.tolist()) for i, v in enumerate(np.vstack([clusters(30, seed=5), data[:10]]))]
    got = knn(
        spark.createDataFrame(queries, Q), spark.createDataFrame(vectors, V).repartition(5), 9, metric, dim=data.shape[1],
        max_broadcast_queries=bound, n_cells=8, max_distance=cut,
    )
    expected = {at: hit for at, hit in brute(queries, vectors, 9, metric).items() if hit[1] <= cut}
    assert as_dict(got) == expected and bool(expected) == (cut >= 0)


@pytest.mark.parametrize("bound", [50_000, 0])
def test_fewer_vectors_than_asked_for(spark, bound):
    q = spark.createDataFrame([(1, [1.0, 0.0])], Q)
    v = spark.createDataFrame([("a", [0.0, 1.0], "x"), ("b", [1.0, 0.0], "y")], V)
    assert as_dict(knn(q, v, 5, dim=2, max_broadcast_queries=bound)) == {(1, 1): ("b", 0.0), (1, 2): ("a", 1.0)}


@pytest.mark.parametrize("bound", [50_000, 0])
def test_unusable_vectors_have_no_hits(spark, bound):
    q = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0])], Q
    )
    v = spark.createDataFrame(
        [("a", [0.0, 1.0], "x"), ("b", [0.0, 0.0], "y"), ("c", None, "z"), ("d", [1.0, 1.0, 1.0], "z")], V
    )
    assert as_dict(knn(q, v, 5, dim=2, max_broadcast_queries=bound)) == {(1, 1): ("a", 1.0)}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_a_stored_index_is_searched_in_two_passes(spark, tmp_path, monkeypatch, metric):
    data = clusters(2000)
    vectors = [(f"k{i * 7919 % 2000}", v.tolist(), f"t{i}") for i, v in enumerate(data)]
    queries = [(i, v.tolist()) for i, v in enumerate(np.vstack([clusters(30, seed=5), data[:10]]))] + [(99, None)]
    path = str(tmp_path / "v")
    df = spark.createDataFrame(vectors, V).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(40)).cast("int"))
    df.repartition("bucket").write.partitionBy("bucket").parquet(path)
    stored, asked = spark.read.parquet(path), spark.createDataFrame(queries, Q)
    seen, leaving = module._k_best, {}

    def k_best(candidates, k):
        leaving.setdefault(share, []).append(candidates.count())
        return seen(candidates, k)

    monkeypatch.setattr(module, "_k_best", k_best)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # the cost of opening a file: every file is a task
    try:
        for share in (1, 8):
            got = as_dict(knn(asked, stored, 9, metric, dim=data.shape[1], first_share=share, metadata=["title"]))
            assert got == brute(queries[:-1], vectors, 9, metric)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # One number is of the only pass; else the first pass's, and what is left of it with the second's.
    assert len(leaving[1]) == 1 and len(leaving[8]) == 2 and sum(leaving[8]) < 0.6 * leaving[1][0], leaving
    rest = module._search_within(module.pa.array([0]), data[:1], np.zeros(1), stored.filter("pmod(bucket, 8) != 0"), asked.schema["query_id"], 9, metric, 8)
    assert "pmod(bucket" in plan_of(rest).split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_cells_on_two_levels_leave_most_visits_out():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(100, 8)) * 10
    v = centres[rng.integers(0, 100, 20_000)] + rng.normal(size=(20_000, 8)) * 0.3
    v[:500] = v[0]
    cells = module._Cells(np.unique(v[::50], axis=0))
    assert 10 < len(cells.lower) < 30 and cells.n == len(np.unique(v[::50], axis=0))
    cell, radius, upper = cells.nearest(v)
    Extent = namedtuple("Extent", "cell n a b c d")
    of = [cell == c for c in range(cells.n)]
    cells.bound([Extent(c, m.sum(), radius[m].min(), radius[m].max(), upper[m].min(), upper[m].max()) for c, m in enumerate(of) if m.any()], 5)
    assert cells.size.sum() == len(v)
    q = v[1::100] + 0.01
    gaps = np.sqrt(((q[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))
    counts = []
    for within in (3.0, 1.0, 0.3):
        qi, ci = cells.visits(q, np.full(len(q), within))
        visited = set(zip(qi.tolist(), ci.tolist()))
        at, near = np.nonzero(gaps <= within)
        assert set(zip(at.tolist(), cell[near].tolist())) <= visited
        counts.append(len(visited))
    assert counts[0] < 0.1 * len(q) * cells.n and counts[0] > counts[1] > counts[2]
    home = cells.nearest(q, True)[0]
    assert (cells.size[home] >= 5).all()


def test_blocks_of_cells():
    first, parts = module._blocks(np.array([3, 0, 4, 25, 2, 9, 1, 10]), 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 5, 5, 6] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1]


def test_rows_sent_grow_with_blocks_not_with_visits(spark, monkeypatch):
    """Of vectors without clusters each query visits nearly every cell: it is sent once for each block of vectors."""
    monkeypatch.setattr(module, "BLOCK_BYTES", 250 * 8 * 8)
    sent = []
    blocks = module._blocks
    monkeypatch.setattr(module, "_blocks", lambda size, rows: sent.append((blocks(size, rows), size)) or blocks(size, rows))
    v = np.random.default_rng(4).normal(size=(1000, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    q = spark.createDataFrame(rows, Q)
    got = knn(q, spark.createDataFrame([(f"k{i}", x, "t") for i, x in rows], V), 5, dim=8, metric="euclidean", max_broadcast_queries=0, n_cells=60)
    assert as_dict(got) == brute(rows, [(f"k{i}", x, "t") for i, x in rows], 5, "euclidean")
    assert [size.sum() for _, size in sent] == [1000, 1000]
    assert all(4 <= first[-1] + parts[-1] <= 15 for (first, parts), _ in sent)


def test_hits_leave_once_a_group_of_blocks(spark, monkeypatch):
    """Of vectors without clusters every pair of blocks meets: a query's hits leave for a few groups, not for each block."""
    monkeypatch.setattr(module, "BLOCK_BYTES", 50 * 8 * 32)
    v = np.random.default_rng(4).normal(size=(1000, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    seen, leaving = module._k_best, []
    monkeypatch.setattr(module, "_k_best", lambda found, k: leaving.append(found.count()) or seen(found, k))
    stored = spark.createDataFrame([(f"k{i}", x, "t") for i, x in rows], V)
    got = knn(spark.createDataFrame(rows, Q), stored, 5, dim=32, metric="euclidean", max_broadcast_queries=0, n_cells=200)
    assert as_dict(got) == brute(rows, [(f"k{i}", x, "t") for i, x in rows], 5, "euclidean")
    # The home cells, then the groups; block by block it was 71 hits of a query that left.
    assert len(leaving) == 2 and 5 * len(rows) <= leaving[1] <= 30 * len(rows), leaving


def test_groups_of_blocks(spark):
    n = 4 * spark.sparkContext.defaultParallelism
    routes = [(q, v) for q in range(2) for v in range(2 * n - q)]
    number, of_q, of_v = module._groups(spark.createDataFrame(routes, "q_block int, v_block int"))
    met = of_q.join(of_v, "group").select("q_block", "v_block").collect()
    assert sorted(map(tuple, met)) == routes
    assert number == of_v.select("group").distinct().count() and max(r["count"] for r in of_v.groupBy("group").count().collect()) <= 4
    assert module._groups(spark.createDataFrame([], "q_block int, v_block int"))[0] == 1


def test_cells_run_the_embedder_once_a_text(spark, tmp_path):
    seen = tmp_path / "texts"

    def load():
        def model(texts):
            with open(seen, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return [[len(t), 1.0] for t in texts]

        return model

    texts = spark.createDataFrame([(f"k{i}", "x" * i) for i in range(1, 60)], "key string, t string")
    vectors = embed(texts, "t", batch_embedder(load))
    q = spark.createDataFrame([(1, [3.0, 1.0]), (2, [50.0, 1.0])], Q)
    got = knn(q, vectors, 1, "euclidean", dim=2, max_broadcast_queries=0, n_cells=4)
    assert as_dict(got) == {(1, 1): ("k3", 0.0), (2, 1): ("k50", 0.0)}
    assert sorted(map(len, seen.read_text().split())) == list(range(1, 60))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("limit", [np.inf, 0.3, 0.0, 1e9])
@pytest.mark.parametrize("size", [1.0, 1e6])
def test_kept_of_tables_one_after_the_other(metric, limit, size):
    """Tables larger than a tile, with ties that the key decides, some queries seen alone."""
    v, q = clusters(2000) * size, np.vstack([clusters(600, seed=5), clusters(2000)[:20]]) * size
    keys = [f"k{i * 7919 % 2000}" for i in range(2000)]
    table = module.pa.table({"key": keys, "embedding": module.pa.array(v.tolist(), module.pa.list_(module.pa.float32()))})
    _, queries = module._scaled(module.pa.array(q.tolist(), module.pa.list_(module.pa.float32())), metric, 8)
    kept = module._Kept(module.pa.array(np.arange(len(q))), queries, np.full(len(q), limit), 9, metric, ["key"])
    for at in range(0, 2000, 700):
        part = module._by_key(table.slice(at, 700))
        rows, near = module._scaled(part["embedding"], metric, 8)
        for some in (np.arange(0, len(q), 2), np.arange(1, len(q), 2)):
            kept.see(part, rows, near, some)
    got = sorted(r for b in kept.batches() for r in zip(*(b[c].to_pylist() for c in ("query_id", "distance", "key"))))
    every = module._scaled(table["embedding"], metric, 8)[1]
    expected = [
        (i, d, key) for i, one in enumerate(queries)
        for d, key in sorted(zip(module._gaps(np.tile(one, (2000, 1)), every, metric).tolist(), keys))[:9] if d <= limit
    ]
    assert got == sorted(expected)


def test_gate_cutoff_and_metadata(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], Q)
    v = spark.createDataFrame([("a", [0.0, 1.0], "x"), ("b", [1.0, 0.1], "y")], V)
    assert knn(q, v, dim=2, enabled=False, metadata=["title"]).collect() == []
    rows = knn(q, v, dim=2, max_distance=0.5, metadata=["title"]).collect()
    assert [(r.key, r.title) for r in rows] == [("b", "y")]
    empty = v.filter("key = 'none'")
    assert knn(q, empty, dim=2).count() == 0 and knn(q.filter("query_id > 1"), v, dim=2).count() == 0
    with pytest.raises(ValueError):
        knn(q, v, dim=2, metric="manhattan")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan(spark, tmp_path):
    vectors = [(f"k{i}", v.tolist(), f"t{i}") for i, v in enumerate(clusters(60))]
    path = str(tmp_path / "v")
    spark.createDataFrame(vectors, V).withColumn("chunk_text", F.lit("x")).write.parquet(path)
    q = spark.createDataFrame([(1, vectors[0][1])], Q)
    plan = plan_of(knn(q, spark.read.parquet(path), 3, dim=len(vectors[0][1]), metadata=["title"]))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    scans = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line]
    assert sorted(scans) == ["struct<key:string,embedding:array<float>>", "struct<key:string,title:string>"]
