"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and their first bytes learns from confirmed toxic documents and unlabelled ones. With the
share pi of toxic documents, the risk is pi * E_positive[loss(+)] + max(0, E_unlabelled[loss(-)] -
pi * E_positive[loss(-)]): the part that estimates the risk on clean text may not become negative.
Where a batch makes it so, the step goes up that part's gradient instead of down. The bias is then moved to
where the same data's estimate of wrong decisions is least, on documents left out of training.
"""

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import features

VIEW = features.View(prefixes=(4, 5, 6, 7, 8), lower=True)
# Documents used for training, at most: those of the smallest hashes.
MAX_POSITIVE, MAX_UNLABELLED = 2000, 4000
EPOCHS, BATCHES, RATE, DECAY = 40, 16, 0.2, 1e-5
SUPPORT, LEAST_RATIO = 5, 0.5
PARTS = 4  # each is left out once to place the bias
THRESHOLD = 0.5


def log_ratio(y: np.ndarray, ends: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """How much more often a feature is in positive than in unlabelled documents, as a logarithm that
    SUPPORT imagined documents draw to zero. Features scale by it; weak ones go out."""
    label = np.repeat(y, np.diff(ends))
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    share = [np.bincount(bucket[label == k], minlength=features.BUCKETS) / n[k] for k in (0, 1)]
    shrink = SUPPORT / n[1]
    ratio = np.log((share[1] + shrink) / (share[0] + shrink))
    return np.where(np.abs(ratio) >= LEAST_RATIO, ratio, 0.0)


def nonnegative_pu(prior: float):
    """Training function for labels 1 (positive) and 0 (unlabelled)."""

    def train(y: np.ndarray, ends: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
        weights = np.zeros(features.BUCKETS + 1)
        positive, unlabelled = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(positive) or not len(unlabelled):
            return weights
        ratio = log_ratio(y, ends, bucket)
        used = ratio[bucket] != 0
        ends = np.append(0, np.cumsum(used))[ends]
        bucket = bucket[used]
        value = value[used] * ratio[bucket]
        rng = np.random.default_rng(1)
        m, v, t = np.zeros_like(weights), np.zeros_like(weights), 0
        for _ in range(EPOCHS):
            parts = [np.array_split(rng.permutation(x), BATCHES) for x in (positive, unlabelled)]
            for p, u in zip(*parts, strict=True):
                if not len(p) or not len(u):
                    continue
                rows = np.concatenate([p, u])
                size = ends[rows + 1] - ends[rows]
                at = np.repeat(ends[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
                of = np.repeat(np.arange(len(rows)), size)
                i, x = bucket[at], value[at]
                score = np.bincount(of, weights[i] * x, len(rows)) + weights[-1]
                toxic = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
                is_p = np.arange(len(rows)) < len(p)
                # Logistic losses: as toxic log(1 + e^-s), as clean log(1 + e^s).
                as_clean = np.logaddexp(0, score)
                clean_risk = as_clean[~is_p].mean() - prior * as_clean[is_p].mean()
                d_clean = np.where(is_p, -prior * toxic / len(p), toxic / len(u))
                d = np.where(is_p, prior * (toxic - 1) / len(p), 0) + d_clean if clean_risk >= 0 else -d_clean
                g = np.bincount(i, d[of] * x, len(weights)) + DECAY * weights
                g[-1] = d.sum()
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                weights -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return weights * np.append(ratio, 1.0)

    return train


def least_wrong(score: np.ndarray, y: np.ndarray, prior: float) -> float:
    """The score from which on documents are best called toxic. The share of wrong decisions is
    unlabelled called toxic - 2 * prior * positive called toxic, and a constant; of equal shares the
    highest score counts. The cut is half the way from there to the next lower score."""
    n = [(y == k).sum() for k in (0, 1)]
    if not all(n):
        return 0.0
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(np.where(y[order] == 1, -2 * prior / n[1], 1 / n[0]))
    ranked = score[order]
    last = np.append(ranked[1:] < ranked[:-1], True)  # of equal scores
    at = np.flatnonzero(last)[wrong[last].argmin()]
    if wrong[at] >= 0:
        return float(ranked[0]) + 1.0  # calling none toxic is best
    return float(ranked[at] + ranked[at + 1]) / 2 if at + 1 < len(ranked) else float(ranked[at])


def with_placed_bias(train: Callable[..., np.ndarray], prior: float) -> Callable[..., np.ndarray]:
    """`train`, and the bias moved so that a score of zero is the `least_wrong` cut of documents left out."""

    def placed(y: np.ndarray, ends: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
        weights = train(y, ends, bucket, value)
        size, score = np.diff(ends), np.zeros(len(y))
        for part in range(PARTS):
            out = np.arange(len(y)) % PARTS == part
            of_rest = np.repeat(~out, size)
            rest = train(y[~out], np.append(0, np.cumsum(size[~out])), bucket[of_rest], value[of_rest])
            product = rest[bucket[~of_rest]] * value[~of_rest]
            score[out] = np.bincount(np.repeat(np.arange(out.sum()), size[out]), product, out.sum()) + rest[-1]
        weights[-1] -= least_wrong(score, y, prior)
        return weights

    return placed


def fit(docs: DataFrame, labels: DataFrame, positives: int = MAX_POSITIVE, unlabelled: int = MAX_UNLABELLED) -> np.ndarray:
    """Weights from `labels` (doc_id, toxic) outside the held-out fold. The class prior is the share
    of toxic documents among all these labels; unlabelled texts are documents of the same folds,
    whatever their labels."""
    known = features.labelled(labels, "toxic")
    prior = known.agg(F.avg("y")).first()[0] or 0.0
    toxic = features.first_rows(known.where("y = 1"), positives)
    rest = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~features.held_out("doc_id")).distinct()
    rest = features.first_rows(rest, unlabelled).withColumn("y", F.lit(0))
    examples = features.vectors(docs, toxic, VIEW, positives).unionByName(features.vectors(docs, rest, VIEW, unlabelled))
    return features.train_in_task(examples, with_placed_bias(nonnegative_pu(prior), prior))


def toxicity_scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text).

    Null, empty and blank texts get the bias's score. One row per input row, repeated rows and null
    doc_ids included; other columns are ignored. Without toxic labels every score is one half.
    """
    return features.score(docs, weights, VIEW, threshold=THRESHOLD)
