"""Quality rules: counted rules plus a log-likelihood ratio of hashed n-grams.

The ratio compares two multinomials over hashed byte n-grams: that of a trusted target and that of
the raw corpus. The raw corpus is counted over all documents, the target over all trusted ones. A
document's score is the mean ratio of its n-grams, so it does not grow with the length; a document
scoring below a fixed threshold fails.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import SpanHash, documents, mix, row_sums, rows_of, word_spans
from corpusflow.session import materialize

GRAM = 3
BUCKETS = 1 << 16
THRESHOLD = -0.5
# Trusted ids that every task can hold. Of more, the documents are shuffled to their ids.
BROADCAST_IDS = 1 << 21
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram, and its row. N-grams do not cross rows."""
    if len(data) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.zeros(len(data) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        key = (key << np.uint64(8)) | data[i : len(data) - GRAM + 1 + i]
    row = rows_of(offsets)
    inside = row[: len(key)] == row[GRAM - 1 :]
    return (mix(key[inside]) % np.uint64(BUCKETS)).astype(np.int64), row[: len(key)][inside]


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, offsets in documents(batch):
            total += np.bincount(gram_buckets(data, offsets)[0], minlength=BUCKETS)
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])


def multinomial(texts: DataFrame) -> np.ndarray:
    """Counts of all n-grams of all texts, added up by Spark; at most BUCKETS rows reach the driver."""
    counts = texts.select("text").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS)
    for row in counts.collect():
        total[row.bucket] = row.n
    return total


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(p target / p raw) of every bucket, both smoothed by one count per bucket."""
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def repeat_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of each row that lie in a 3-word window found twice or more in that row."""
    n = len(offsets) - 1
    if len(starts) < 4:
        return np.zeros(n, np.int64)
    row = rows_of(offsets)[starts]
    word = SpanHash(data)(starts, ends)
    same = row[:-2] == row[2:]
    window = mix(word[:-2] + mix(word[1:-1] + mix(word[2:] + row[2:].astype(np.uint64))))
    ordered = np.sort(window[same])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    at = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
    found = same & (twice[at] == window)
    covered = np.zeros(len(starts), bool)
    for i in range(3):
        covered[i : len(covered) - 2 + i] |= found
    return np.bincount(row[covered], minlength=n)


def dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def measure(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """All counts and the score of each row."""
    starts, ends = word_spans(data, offsets)
    row = rows_of(offsets)
    whole = data.tobytes()
    bucket, gram_row = gram_buckets(data, offsets)
    n = len(offsets) - 1
    grams = np.bincount(gram_row, minlength=n)
    ratio = np.bincount(gram_row, weights[bucket], n) / np.maximum(grams, 1)
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    points = (data & 0xC0) != 0x80
    return {
        "n_words": np.bincount(row[starts], minlength=n),
        "word_chars": row_sums(points & ~blank[data], offsets),
        "n_symbols": row_sums(_SYMBOL[data], offsets),
        "n_dup_lines": np.array([dup_lines(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64),
        "n_repeat_words": repeat_words(data, offsets, starts, ends),
        "score": ratio,
    }


def verdict(found: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
    return failed, ~failed & (found["score"] >= threshold)


def _judge(weights, threshold: float, whole_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for first, last, data, offsets in documents(batch):
                found = measure(data, offsets, w)
                failed, kept = verdict(found, threshold)
                part = batch.slice(first, last - first)
                if whole_rows:
                    yield part.filter(pa.array(kept))
                    continue
                columns = [part.column("doc_id"), *(pa.array(found[c]) for c in COUNTS), pa.array(found["score"]), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "score", "base_failed", "kept"])

    return run


def fit(docs: DataFrame, trusted: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> np.ndarray:
    """Log ratios of the n-gram buckets. `trusted` has the doc_id of trusted documents, all of which are
    used. Up to `broadcast_ids` ids are broadcast and no text is moved; of more, the texts are shuffled
    once and not sorted. That doesn't change the result."""
    ids = materialize(trusted.select("doc_id").where("doc_id is not null").distinct(), "trusted")
    ids = ids.hint("broadcast" if ids.count() <= broadcast_ids else "shuffle_hash")
    target = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return log_ratio(multinomial(target), multinomial(docs))


def quality_rules(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, score and verdict of every row of `docs` (doc_id, text).

    One row per input row, repeated rows and null doc_ids included; other columns are ignored. A
    null or empty text has no words, so it fails. Without trusted documents or without documents
    every ratio is a constant, and only the counted rules and the threshold decide.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, score double, base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(_judge(shared, threshold, False), schema)


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(_judge(shared, threshold, True), docs.schema)
