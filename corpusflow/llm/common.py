"""Helpers shared by the operators of this subpackage: text bytes as NumPy arrays, span hashes,
connected components, numbering."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import materialize

# Bytes of texts worked on at a time: the arrays made of them take up to some hundred times as many in each Python worker.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, end to end, and the offsets of its rows. A null is empty."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    where, data = column.buffers()[1:]
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes together; a longer row is a range of its own."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def documents(batch: pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of the text column, a bounded number of bytes at a time."""
    data, offsets = utf8(batch.column("text"))
    for first, last in pieces(offsets, most):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `values` in each row."""
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each byte."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(str(base))
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK_BYTES + 1), np.uint64(base))
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _POWERS[str(base)] = known
    return known


class SpanHash:
    """64-bit polynomial hashes of any spans of a byte array, each from two prefix sums."""

    def __init__(self, data: np.ndarray):
        powers = _powers(BASE, len(data) + 1)
        self._prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self._prefix[1:])
        self._inverse = _powers(pow(BASE, -1, 1 << 64), len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._prefix[end] - self._prefix[start]) * self._inverse[start])

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n bytes from each position that has n bytes after it."""
        count = max(0, len(self._prefix) - n)
        return mix((self._prefix[n:] - self._prefix[:count]) * self._inverse[:count])


BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII blanks); no word crosses a row."""
    return runs(~BLANKS[data], offsets)


def runs(ink: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a row."""
    starts, ends = ink.copy(), ink.copy()
    starts[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(ink))]
    starts[edges] = ink[edges]
    ends[edges - 1] = ink[edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def min_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each of n nodes' component under the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every linked node; the root is the smallest node of its component.

    Alternating large-star and small-star steps. Each is a minimum by node, combined before the
    shuffle, joined back to the links; a node that holds many of the links is split by the
    skew join, never gathered. Every round is written to the shared folder.
    """
    links = materialize(
        links.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links"
    )
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.select("v", "m").where("v != m").union(star.select("u", "m")).toDF("u", "v").distinct()
        before, links = links, materialize(small, "links")
        # Nothing has moved when these are the links there were.
        if links.count() == before.count() and links.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
