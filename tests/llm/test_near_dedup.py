"""Near copies of the pipeline: exact links, recall at the edge, rows kept."""

import random
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import common, near_dedup, simhash

SCHEMA = "doc_id long, text string, text_key string, node long, u long, root int"


def grams(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def prose(rng, words):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(words))


def changed(rng, text, goal):
    """`text` with single words changed until its similarity would fall below `goal`."""
    words, before = text.split(), text
    for i in rng.sample(range(len(words)), len(words)):
        now = " ".join([*words[:i], "new", *words[i + 1 :]])
        if similarity(text, now) < goal:
            return before
        words, before = now.split(), now
    return before


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA).repartition(4)
    out = near_dedup.keep_first(docs)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_pairs_at_the_edge(spark):
    """Nine of ten pairs and more from 0.8 on are one group; none below 0.8 is."""
    rng = random.Random(5)
    rows, close = [], set()
    for n in range(240):
        text = prose(rng, rng.choice([60, 150, 300]))
        other = changed(rng, text, [0.8, 0.74, 0.85, 0.4][n % 4])
        rows += [(2 * n, text), (2 * n + 1, other)]
        close |= {2 * n + 1} if similarity(text, other) >= 0.8 else set()
    gone = {i for i, _ in rows} - {i for i, _ in kept(spark, rows)}
    assert gone <= close and len(close) >= 100 and len(gone) >= 0.95 * len(close)


def test_rows_without_id_and_ids_of_two_texts(spark):
    rng = random.Random(6)
    texts = [prose(rng, 80) for _ in range(60)]
    rows = [(i if i < 40 else None, t) for i, t in enumerate(texts)]
    assert kept(spark, rows) == sorted(rows, key=str)
    near = changed(rng, texts[7], 0.9)
    more = [(50, texts[3]), (50, texts[3]), (51, texts[50]), (50, prose(rng, 80)), (None, texts[8]), (None, near), (2, texts[2])]
    unique = [(50, more[3][1]), (51, texts[50])]
    expected = [r for r in rows if r[1] != texts[50]] + unique
    assert kept(spark, rows + more) == sorted(expected, key=str)


def test_odd_texts(spark):
    rng = random.Random(7)
    long = prose(rng, 60_000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "é " * 900), (8, "é " * 500), (9, long), (10, long + " end"), (11, "la " * 5)]
    assert [i for i, _ in kept(spark, rows)] == sorted([1, 4, 6, 7, 9, 11], key=lambda i: str((i, dict(rows)[i])))
    assert kept(spark, []) == []


def test_hot_group_of_near_copies(spark, monkeypatch):
    """A large group of near copies, cut into cells: links do not grow with its square."""
    monkeypatch.setattr(near_dedup, "CELL_ROWS", 64)
    rng = random.Random(8)
    text = prose(rng, 200)
    rows = [(i, changed(rng, text, rng.choice([0.93, 0.97]))) for i in range(400)] + [(1000 + i, prose(rng, 90)) for i in range(100)]
    assert [i for i, _ in kept(spark, rows)] == sorted([0, *range(1000, 1100)], key=lambda i: str((i, dict(rows)[i])))


def test_shingle_sets():
    rng = random.Random(9)
    texts = [prose(rng, n) for n in (0, 1, 3, 4, 5, 6, 50)] + ["a b c d e " * 20, "A B c", "a b c", "", "x"]
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    offsets[-1] -= 1
    bounds, hashes = near_dedup.shingle_sets(data, offsets)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [len(s) for s in sets] == [len(grams(t)) for t in texts] and np.diff(bounds).tolist() == [len(s) for s in sets]
    for i, j in combinations(range(len(texts)), 2):
        assert len(sets[i] & sets[j]) == len(grams(texts[i]) & grams(texts[j]))


@pytest.mark.parametrize("seed", range(4))
def test_candidates_span_all_near_rows(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, (30, near_dedup.SKETCH), dtype=np.int64).view(np.uint64)
    words = base[rng.integers(0, 30, 300)] ^ (np.uint64(1) << rng.integers(0, 64, (300, near_dedup.SKETCH), dtype=np.uint64))
    end = np.repeat([120, 300], [120, 180])
    a, b = near_dedup.candidate_links(end, np.zeros(300, int), words, 40)
    bits = np.bitwise_count(words[:, None] ^ words).sum(2)
    run = end[:, None] == end
    x, y = np.nonzero((bits <= 40) & run)
    assert (common.min_labels(a, b, 300) == common.min_labels(x, y, 300)).all()
    assert (bits[a, b] <= 40).all() and len(a) < 300
    # The lightest links: no larger sum of bits than any other spanning forest has.
    order = np.argsort(bits[x, y], kind="stable")
    total, label = 0, np.arange(300)
    for i in order:
        p, q = label[x[i]], label[y[i]]
        if p != q:
            total += bits[x[i], y[i]]
            label[label == q] = p
    assert bits[a, b].sum() == total


@pytest.mark.parametrize("n", [10, 10**5, 10**7, 10**9, 10**11])
def test_plans_find_enough_at_any_size(n):
    counts = np.full((64, 64), n / 4)
    np.fill_diagonal(counts, n / 2)
    parts = near_dedup.plan(n, counts, 0.8)
    assert near_dedup.missed(parts, near_dedup.differing_share(0.8)) ** near_dedup.SKETCH <= 1 - near_dedup.RECALL
    assert sum(len(bits) for bits, _ in parts) <= 64 and sum(t + 1 for _, t in parts) >= near_dedup.MAX_BITS + 1
    assert simhash.BITS == 64


def test_no_pair_is_left_out(spark, monkeypatch):
    """Every pair of the similarity is linked, also where the sketches bring no pair together; hot lines and all sizes of texts."""
    none = spark.createDataFrame([], "u long, v long")
    rng = random.Random(12)
    line = prose(rng, 30)
    rows = []
    for n in range(120):
        text = prose(rng, [5, 9, 25, 80, 200][n % 5])
        text = f"{text} {line}" if n % 3 == 0 else text
        rows += [(3 * n, text), (3 * n + 1, changed(rng, text, [0.8, 0.74, 0.85, 0.4][n % 4])), (3 * n + 2, changed(rng, text, 0.9))]
    sets = [grams(t) for _, t in rows]
    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j])]
    label = common.min_labels(*(np.array(x) for x in zip(*pairs)), len(rows))
    expected = sorted((rows[i] for i in set(label.tolist())), key=str)
    assert len(pairs) > 150 and kept(spark, rows) == expected
    monkeypatch.setattr(near_dedup, "candidates", lambda classes, similarity: none)
    monkeypatch.setattr(near_dedup, "PAIRS_AT_ONCE", 7)
    assert kept(spark, rows) == expected


def test_crossing_pairs(monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS_AT_ONCE", 5)
    rng = np.random.default_rng(3)
    run, root = (np.sort(rng.integers(0, n, 60)) for n in (6, 20))
    root = root[np.lexsort((root, run))]
    end = np.searchsorted(run, run, "right")
    order = np.lexsort((root, run))
    root, number, size = root[order], rng.permutation(60), rng.integers(8, 12, 60)
    got = [(u, v) for x in near_dedup.crossing_pairs(end, root, number, size, 0.8) for u, v in zip(*x)]
    expected = {(max(number[i], number[j]), min(number[i], number[j])) for i, j in combinations(range(60), 2)
                if run[i] == run[j] and root[i] != root[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j])}
    assert set(got) == expected and expected


def test_parities():
    """They differ in no more bits than the sets in shingles, at any sizes; sets that differ much are told apart."""
    rng = np.random.default_rng(4)
    sets = []
    for n in (0, 1, 15, 16, 17, 100, 1000, 1100, 3000):
        base = rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64)
        sets += [np.unique(np.append(base[k:], rng.integers(0, 1 << 63, k, dtype=np.int64).view(np.uint64))) for k in {0, n // 20, n // 4, n // 2}]
    found = near_dedup.Parities(pa.array([b"", *map(near_dedup.parities, sets)], pa.binary())[1:])
    a, b = np.array(list(combinations(range(len(sets)), 2))).T
    bits, apart = found.differ(a, b), np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    assert (bits <= apart).all() and (bits[apart == 0] == 0).all()
    size = np.array([len(x) for x in sets])
    far = (size[a] == size[b]) & (size[a] >= 100) & (apart > 0.4 * size[a])
    assert far.any() and (bits[far] > 0.25 * size[a][far]).all()


@pytest.mark.parametrize("most", [8192, 50])
def test_loose_group_makes_few_pairs(spark, monkeypatch, most):
    """Texts that share most shingles but are no near copies: their pairs, which grow with the square of the group, do not leave the tasks."""
    monkeypatch.setattr(near_dedup, "CELL_ROWS", most)
    rng = random.Random(13)
    text = prose(rng, 200)
    texts = [changed(rng, text, rng.choice([0.8, 0.82])) for _ in range(150)]
    sets = [grams(t) for t in texts]
    close = {(i, j) for i, j in combinations(range(150), 2) if len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.xxhash64("text"))
    rows = near_dedup.sketches(docs).select(F.col("shingles").alias("node"), "doc_id", F.struct(F.lit(False), "doc_id", "key").alias("first"))
    rows = rows.withColumn("root", F.col("node")).withColumn("first", F.col("first").cast("struct<nameless:boolean,doc_id:long,key:long>"))
    known = {r.node: r.doc_id for r in rows.collect()}
    pairs = [(r.u, r.v) for r in near_dedup.missed_pairs(docs, rows.drop("doc_id"), 0.8).collect()]
    assert len(pairs) == len(set(pairs)) and {tuple(sorted((known[u], known[v]))) for u, v in pairs} >= close
    assert len(pairs) <= len(close) + 450


def test_worker_memory_is_bounded():
    """Arrays made of a batch's texts, and of the pairs of a large group, stay small whatever the batch and the group hold."""
    def peak(work):
        tracemalloc.start()
        try:
            return work(), tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    rng = random.Random(14)
    texts = [prose(rng, 400) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict({"u": range(2000), "v": range(2000), "text_u": texts, "text_v": [t + " end" for t in texts[:1900]] + texts[:100]})
    assert batch.nbytes > 8e6
    found, mb = peak(lambda: list(near_dedup._similar(0.8)([batch])))
    assert [x for b in found for x in b.column("u").to_pylist()] == list(range(1900)) and mb < 40
    texts = batch.select(["text_u"]).rename_columns(["text"])
    assert peak(lambda: [near_dedup.shingle_sets(d, o) and None for _, _, d, o in common.documents(texts)])[1] < 40

    numbers = np.random.default_rng(14)
    sets = [numbers.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64) for n in numbers.integers(120, 150, 1500)]
    bits = pa.array([near_dedup.parities(x) for x in sets], pa.binary())
    end, index, size = np.full(1500, 1500), np.arange(1500), np.array([len(x) for x in sets])
    pairs, mb = peak(lambda: sum(len(u) for u, _ in near_dedup.crossing_pairs(end, index, index, size, 0.8, near_dedup.Parities(bits))))
    assert pairs == 0 and mb < 40
