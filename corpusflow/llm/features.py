"""Hashed word n-grams of texts as sparse vectors, and the labelled samples that models learn from."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import SpanHash, documents, mix, rows_of

BUCKETS = 1 << 18
FOLDS = 5

# A word is a run of letters (all beyond ASCII count as letters), of digits, or of other signs.
_KIND = np.full(256, 3, np.uint8)
_KIND[128:] = 1
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class View:
    """What a text's features are: word 1- to `grams`-grams, a two-gram of one word twice being the
    same for all words, and words' first bytes (for stems) of the lengths `prefixes`."""

    grams: int = 1
    prefixes: tuple[int, ...] = ()
    lower: bool = False


def sparse_rows(data: np.ndarray, offsets: np.ndarray, view: View) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the features of each row, ordered by row and bucket.

    The value is the root of a bucket's share of the row's features, so every row with a word has
    length one whatever its size; a row without words has no entries.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    data = _LOWER[data] if view.lower else data
    kind, row = _KIND[data], rows_of(offsets)
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(edge)
    words = kind[at[:-1]] > 0
    start, end = at[:-1][words], at[1:][words]
    span, of = SpanHash(data), row[start]
    word, keys = span(start, end), []

    def add(rows: np.ndarray, hashes: np.ndarray, kind: int) -> None:
        keys.append(rows * BUCKETS + (mix(hashes + np.uint64(kind)) % np.uint64(BUCKETS)).astype(np.int64))

    add(of, word, 1)
    for n in range(2, min(view.grams, len(word)) + 1):
        size = len(word) - n + 1
        gram, same = word[:size], of[:size] == of[n - 1 :]
        for i in range(1, n):
            gram = mix(gram + word[i : i + size] * np.uint64(2 * i + 1))
        if n == 2:
            gram = np.where(word[:-1] == word[1:], np.uint64(0), gram)
        add(of[:size][same], gram[same], n)
    for n in view.prefixes:
        longer = end - start > n
        add(of[longer], span(start[longer], start[longer] + n), 100 + n)
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    r = key[first] // BUCKETS
    total = np.bincount(r, count, len(offsets) - 1)
    return r, key[first] % BUCKETS, np.sqrt(count / total[r]).astype(np.float32)


def held_out(doc_id: Column | str) -> Column:
    """Rows that no label may be learned from. A null doc_id isn't held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of the documents whose label may be learned; of contradicting rows the smaller counts."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out("doc_id"))
    return usable.groupBy("doc_id").agg(F.min(column).cast("int").alias("y"))


def first_rows(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, those with the smallest hashes of doc_id."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def vectors(docs: DataFrame, sample: DataFrame, view: View, most: int) -> DataFrame:
    """(h, y, bucket array, value array) of the documents of a bounded `sample` (doc_id, y), `most` at most.

    Rows of one doc_id and text are one document; of more documents than `most`, as ids with many texts
    give, those with the smallest hashes of id and text are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in documents(batch):
                row, bucket, value = sparse_rows(data, offsets, view)
                ends = np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32)
                part = batch.slice(first, last - first)
                columns = [part.column("h"), part.column("y")]
                columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (bucket.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "y", "bucket", "value"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("key", F.xxhash64("text"))
    once = chosen.groupBy("doc_id", "y", "key").agg(F.first("text").alias("text"))
    bounded = once.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "key").limit(most)
    return bounded.select("h", "y", "text").mapInArrow(run, "h long, y int, bucket array<int>, value array<float>")


def train_in_task(examples: DataFrame, train: Callable[..., np.ndarray]) -> np.ndarray:
    """Weights (BUCKETS and a bias) that `train` makes of a bounded sample's vectors, in one task.

    train: gets the labels, row bounds, buckets and values in the order of the rows' hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b for b in batches if len(b)] or [pa.RecordBatch.from_pylist([], schema=schema)])
        lists = [rows.column(c).combine_chunks() for c in ("bucket", "value")]
        ends = np.append(0, np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        bucket, value = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        weights = train(rows.column("y").to_numpy(), ends, bucket, value)
        full = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(weights[full].astype(np.float64))], names=["i", "w"])

    schema = pa.schema([("h", pa.int64()), ("y", pa.int32()), ("bucket", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])
    weights = np.zeros(BUCKETS + 1)
    # A vector orders copies of a row, whose hashes are equal.
    ordered = examples.repartition(1).sortWithinPartitions("h", "y", "bucket")
    for row in ordered.mapInArrow(run, "i long, w double").collect():
        weights[row.i] = row.w
    return weights


def logits(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, view: View) -> np.ndarray:
    """Sparse dot product of each row with the weights, plus the bias."""
    row, bucket, value = sparse_rows(data, offsets, view)
    return np.bincount(row, weights[bucket] * value, len(offsets) - 1) + weights[BUCKETS]


def score(docs: DataFrame, weights: np.ndarray, view: View, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in documents(batch):
                p = 1 / (1 + np.exp(-np.clip(logits(data, offsets, shared.value, view), -30, 30)))
                ids = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(p)], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
