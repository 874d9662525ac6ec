"""The models' training steps and scores against plain versions."""

import random

import numpy as np

from corpusflow.llm import features, quality_model, quality_rules, toxicity
from corpusflow.llm.common import SpanHash


def examples(seed, n, buckets=40):
    rng = np.random.default_rng(seed)
    rows = [np.sort(rng.choice(buckets, rng.integers(0, 8), replace=False)) for _ in range(n)]
    ends = np.cumsum([0] + [len(r) for r in rows])
    bucket = np.concatenate(rows).astype(np.int32)
    y = np.array([int((r < buckets // 3).sum() * 2 > len(r)) for r in rows], np.int32)
    return y, ends, bucket, rng.random(len(bucket)).astype(np.float32)


def test_quality_training():
    """Follow-the-regularised-leader, a coordinate and an example at a time."""
    y, ends, bucket, value = examples(1, 200)
    m = quality_model
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= m.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * m.L1) / ((m.BETA + n[i] ** 0.5) / m.ALPHA + m.L2)

    for _ in range(m.EPOCHS):
        for k in range(len(y)):
            x = dict(zip(bucket[ends[k] : ends[k + 1]].tolist(), value[ends[k] : ends[k + 1]].tolist(), strict=True)) | {-1: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y[k]) * x[i]
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - old**0.5) / m.ALPHA * w[i]
    got = m.ftrl(y, ends, bucket, value)
    assert np.allclose(got[:40], [weight(i) for i in range(40)], atol=1e-9) and abs(got[-1] - weight(-1)) < 1e-9
    assert not got[40:-1].any()


def test_toxicity_training(monkeypatch):
    """One step from zero weights goes along the gradient of the class-prior-corrected risk, or up that of its
    clean part where the estimate is negative."""
    prior = 0.2
    for case in range(2):
        y, ends, bucket, value = examples(case + 5, 60)
        ratio = toxicity.log_ratio(y, ends, bucket)
        plain = np.zeros(features.BUCKETS)
        for b in range(40):
            share = [np.mean([b in bucket[ends[k] : ends[k + 1]] for k in np.flatnonzero(y == c)]) for c in (0, 1)]
            plain[b] = np.log((share[1] + toxicity.SUPPORT / (y == 1).sum()) / (share[0] + toxicity.SUPPORT / (y == 1).sum()))
        plain[np.abs(plain) < toxicity.LEAST_RATIO] = 0
        assert np.allclose(ratio, plain)

        def risk(weights, part, y=y, ends=ends, bucket=bucket, value=value, ratio=ratio):
            score = np.array([sum(weights[b] * v * ratio[b] for b, v in zip(bucket[ends[k] : ends[k + 1]], value[ends[k] : ends[k + 1]], strict=True)) for k in range(len(y))]) + weights[-1]
            clean = np.logaddexp(0, score)
            estimate = clean[y == 0].mean() - prior * clean[y == 1].mean()
            toxic = prior * np.logaddexp(0, -score)[y == 1].mean()
            return estimate if part == "clean" else toxic + max(0.0, estimate)

        monkeypatch.setattr(toxicity, "EPOCHS", 1)
        monkeypatch.setattr(toxicity, "BATCHES", 1)
        got = toxicity.nonnegative_pu(prior)(y, ends, bucket, value)
        zero, step = np.zeros(features.BUCKETS + 1), 1e-6
        assert risk(zero, "clean") > 0
        for i in [*np.flatnonzero(ratio[:40])[:10], -1]:
            moved = zero.copy()
            moved[i] = step
            slope = (risk(moved, "all") - risk(zero, "all")) / step
            scale = ratio[i] if i >= 0 else 1.0
            # The first step of the optimiser has the size RATE against the sign of the gradient.
            assert abs(slope) < 1e-5 or np.isclose(got[i] / scale, -toxicity.RATE * np.sign(slope), rtol=1e-2)


def test_place_of_the_bias():
    """The cut is where the plain count of wrong decisions is least, between two scores."""
    rng = np.random.default_rng(3)
    for case in range(30):
        y = (rng.random(60) < 0.3).astype(int)
        score = np.round(rng.normal(0, 1, 60) + 2.0 * y, 1 + case % 2)
        cut = toxicity.least_wrong(score, y, 0.2)

        def wrong(at, score=score, y=y):
            return (score[y == 0] >= at).mean() - 0.4 * (score[y == 1] >= at).mean()

        every = [wrong(at) for at in [*np.unique(score), score.max() + 1]]
        assert np.isclose(wrong(cut), min(every))
    assert toxicity.least_wrong(np.zeros(3), np.zeros(3, int), 0.2) == 0.0
    assert toxicity.least_wrong(np.array([1.0, 2.0]), np.array([1, 0]), 0.1) > 2.0
    separate = toxicity.least_wrong(np.array([-3.0, -2.0, 4.0, 5.0]), np.array([0, 0, 1, 1]), 0.3)
    assert separate == 1.0


def test_sample_is_bounded_by_rows(spark):
    rows = [(1, f"text {i}") for i in range(300)] + [(2, "same words")] * 400 + [(3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sample = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, y int")
    got = features.vectors(docs, sample, quality_model.VIEW, 100).collect()
    assert len(got) == 100
    assert features.vectors(docs, sample, quality_model.VIEW, 1000).count() == 302


def test_quality_rules_score(spark):
    """The mean log ratio of the buckets of a text's byte 3-grams, from counts over all texts."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc de") for _ in range(rng.randint(0, 400))) for _ in range(80)] + ["", "é", None, "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    trusted = docs.where("doc_id % 4 = 0").select("doc_id")
    weights = quality_rules.fit(docs, trusted)

    def buckets(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        got, row = quality_rules.gram_buckets(data, np.array([0, len(data)]))
        assert len(got) == max(0, len(data) - 2) and not row.any()
        if len(data) > 2:
            assert len(SpanHash(data).grams(3)) == len(got)
        return got.tolist()

    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for i, text in enumerate(texts):
        for b in buckets(text):
            raw[b] += 1
            target[b] += i % 4 == 0
    p, q = (target + 1) / (target.sum() + len(target)), (raw + 1) / (raw.sum() + len(raw))
    assert np.allclose(weights, np.log(p / q))
    for r in quality_rules.quality_rules(docs, weights).collect():
        of = buckets(texts[r.doc_id])
        assert abs(r.score - (sum(np.log(p[b] / q[b]) for b in of) / len(of) if of else 0.0)) < 1e-9
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
