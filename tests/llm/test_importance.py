"""Importance resampling against a plain reading of its definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusflow.llm import importance as imp
from corpusflow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, score string, rank int, row string, weight int, name string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
RNG = random.Random(3)


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target):
    s, t = (Counter(f for x in texts for f in features(x)) for texts in ([r[1] for r in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in rows:
        f = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * 5 // 100], 1):
        r[4] = rank
    return sorted((r[:5] for r in out), key=str)


def prose(n):
    return " ".join("".join(RNG.choice(["ta", "Ri", "mön", "le", "x9"]) for _ in range(RNG.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(RNG.randint(0, 80))) for i in range(500)]
    out += [(600, None), (601, ""), (602, " \n-_,"), (603, "w" * 70 + " " + "é" * 300 + " a " + "b" * 64 + " c"), (604, prose(60_000))]
    out += [(7, out[7][1])] * 40 + [(None, prose(50))] * 30 + [(8, prose(40)), (605, "a,b;c  d\te")]
    return out


def test_crcs_of_any_lengths():
    texts = ["x" * n for n in (0, 1, 63, 64, 65, 200, 5000)] + ["a b", "é" * 40 + "/" + "q" * 129 + " z", prose(500)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = [[] for _ in texts]
    for a, bounds, crcs, there in imp.feature_crcs(data, offsets):
        for n in range(3):
            for i in np.flatnonzero(there[n]):
                got[np.searchsorted(bounds, a + i, "right") - 1].append(int(crcs[n, i]) % 10000)
    assert got == [features(t) for t in texts]


def test_words_over_several_slices(monkeypatch):
    text = prose(100).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = [c[t] for _, _, c, t in imp.feature_crcs(data, offsets)]
    monkeypatch.setattr(imp, "WORDS_AT_ONCE", 7)
    parts = [c[t] for _, _, c, t in imp.feature_crcs(data, offsets)]
    assert sorted(np.concatenate(whole)) == sorted(np.concatenate(parts)) and len(parts) == 15


def run(spark, rows, target):
    docs = spark.createDataFrame([(i, t, "s", 1, "r", 2, "n") for i, t in rows], SCHEMA).repartition(4)
    return sorted(([*r] for r in imp.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()), key=str)


def test_against_brute_force(spark, rows):
    target = [prose(30) for _ in range(20)] + [None, ""]
    assert run(spark, rows, target) == brute(rows, target)


def test_equal_scores_and_empty_tables(spark):
    rows = [(5, "la " * 30)] * 100 + [(6, "la " * 30)] * 20
    got = run(spark, rows, [])
    assert got == brute(rows, []) and sum(r[4] is not None for r in got) == 6
    assert run(spark, [], ["a b"]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


@pytest.mark.parametrize("k", [1, 1000, 2500])
def test_quickselect(spark, k):
    data = [(RNG.randint(-40, 40), RNG.random() < 0.1, RNG.choice([None, 1, 2, 3]), RNG.randint(0, 1), i) for i in range(2500)]
    keys = spark.createDataFrame(data, "below long, nameless boolean, doc_id long, tie long, row long")
    got = keys.limit(1).select(imp.select_key(keys, k).alias("k")).first().k
    assert tuple(got) == sorted(data, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3], r[4]))[k - 1]


def test_query_over_whole_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op12_resample"](spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(([*r] for r in got.collect()), key=str) == brute(rows, target)
