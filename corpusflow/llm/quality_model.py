"""Quality classifier: logistic regression over hashed word n-grams, trained online with
follow-the-regularised-leader (proximal) updates. Most weights stay exactly zero."""

import numpy as np
from pyspark.sql import DataFrame

from corpusflow.llm import features

VIEW = features.View(grams=2)
# Labelled documents used for training, at most: those of the smallest hashes.
MAX_LABELLED = 8000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.001
THRESHOLD = 0.3


def ftrl(y: np.ndarray, ends: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Weights and bias after EPOCHS passes over the examples in their order."""
    z, n = np.zeros(features.BUCKETS + 1), np.zeros(features.BUCKETS + 1)

    def weights(i):
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for k in range(len(y)):
            i = np.append(bucket[ends[k] : ends[k + 1]], features.BUCKETS)
            x = np.append(value[ends[k] : ends[k + 1]], 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y[k]) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(len(z)))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> np.ndarray:
    """Weights from at most `most` documents of `labels` (doc_id, quality) outside the held-out fold."""
    sample = features.first_rows(features.labelled(labels, "quality"), most)
    return features.train_in_task(features.vectors(docs, sample, VIEW, most), ftrl)


def quality_scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text).

    Null, empty and blank texts get the bias's score. One row per input row, repeated rows and null
    doc_ids included; other columns are ignored. Without labels every score is one half.
    """
    return features.score(docs, weights, VIEW, threshold=THRESHOLD)
