"""Importance resampling towards a target's distribution of hashed word n-grams.

Every task counts the buckets of its texts' features in an array; a document's weight is the sum of
the log ratios of its features' buckets, looked up in an array. Its score adds noise of the Gumbel
distribution, drawn from a hash of the doc_id, so the highest scores are a sample without replacement
in proportion to the importance. The k-th highest composite key (score, doc_id) is found by a
distributed quickselect: random keys as pivots, exact counts below and at each, and only the rows
between two of them go on. No row but the winners is sorted.

A feature's bucket is a CRC-32. That of a run of words follows from those of its words: a CRC is
linear, so the first words' is moved over the following word's length by a table and added.
"""

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import documents, row_sums, runs
from corpusflow.llm.sharding import numbered
from corpusflow.session import materialize

BUCKETS = 10_000
GRAMS = 3
SEED = 42
MIN_WORDS = 20
PERCENT = 5
PIVOTS = 15

WORDS_AT_ONCE = 1 << 20
# Words up to this many bytes are moved over by one table; longer ones by powers of two.
_SHORT = 64
_POLYNOMIAL = 0xEDB88320

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INK = np.zeros(256, bool)
_INK[128:] = True
_INK[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True


def _byte_table() -> np.ndarray:
    """The CRC register after one more byte, by the register's lowest byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


_BYTE = _byte_table()


def _moved(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Registers `c` under a linear map given by its values on each of the four bytes."""
    out = table[0][c & np.uint32(255)]
    for k in range(1, 4):
        out ^= table[k][(c >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _over_zeros() -> np.ndarray:
    """Table n: the map that moves a register over n zero bytes, n up to _SHORT."""
    units = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    tables = [units]
    for _ in range(_SHORT):
        tables.append(_BYTE[tables[-1] & 255] ^ (tables[-1] >> np.uint32(8)))
    return np.array(tables, np.uint32)


_ZEROS = _over_zeros()


def moved_over(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved over `length` bytes: with the CRC of these bytes added, the CRC of both together."""
    n = np.minimum(length, _SHORT)
    out = _ZEROS[n, 0, crc & np.uint32(255)]
    for k in range(1, 4):
        out ^= _ZEROS[n, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    rest = np.flatnonzero(length > _SHORT)
    if len(rest):
        c, left, table = out[rest], (length[rest] - _SHORT).astype(np.int64), _ZEROS[1]
        while left.any():
            odd = (left & 1).astype(bool)
            c[odd] = _moved(table, c[odd])
            table, left = _moved(table, table), left >> 1
        out[rest] = c
    return out


def _space_after(crc: np.ndarray) -> np.ndarray:
    state = ~crc
    return ~(_BYTE[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8)))


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, a byte of all spans at a time, longest spans first."""
    length = end - start
    order = np.argsort(-np.minimum(length, _SHORT + 1), kind="stable")
    sizes, first = length[order], start[order]
    long = int(np.searchsorted(-sizes, -_SHORT, "left"))
    sizes, first = sizes[long:], first[long:]
    state = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for j in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -j, "left"))  # spans of more than j bytes
        now = state[:m]
        state[:m] = _BYTE[(now ^ data[first[:m] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty(len(length), np.uint32)
    out[order[long:]] = ~state
    for i in order[:long]:
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def feature_crcs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, row bounds as word numbers, CRCs, which of them exist) of the features of 1 to GRAMS
    words from each word on, a bounded number of words at a time. CRCs: one row per number of words."""
    folded = _FOLD[data]
    start, end = runs(_INK[folded], offsets)
    bounds = np.searchsorted(start, offsets)
    for a in range(0, len(start), WORDS_AT_ONCE):
        b = min(len(start), a + WORDS_AT_ONCE)
        z = min(len(start), b + GRAMS - 1)
        one, length = word_crcs(folded, start[a:z], end[a:z]), end[a:z] - start[a:z]
        row_end = bounds[np.searchsorted(bounds, np.arange(a, b), "right")]
        crcs, there = np.zeros((GRAMS, b - a), np.uint32), np.zeros((GRAMS, b - a), bool)
        crcs[0], there[0] = one[: b - a], True
        for n in range(1, GRAMS):
            there[n] = np.arange(a, b) + n < row_end
            at = np.flatnonzero(there[n])
            crcs[n, at] = moved_over(_space_after(crcs[n - 1, at]), length[at + n]) ^ one[at + n]
        yield a, bounds, crcs, there


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of the column `text` each bucket has: an array per task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in documents(batch):
                for _, _, crcs, there in feature_crcs(data, offsets):
                    total += np.bincount(crcs[there] % np.uint32(BUCKETS), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    counted = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # BUCKETS rows at most
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share of the target to that of the raw texts."""
    s_all, t_all = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratios = [((float(t) + 1) * s_all) / ((float(s) + 1) * t_all) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(name: str | None) -> int:
    """Gumbel noise in thousandths from the hash of a doc_id."""
    h = int(hashlib.sha256(f"{SEED}:{name or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, tie) of every row; tie is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in documents(batch):
                n_words, weight = np.zeros(last - first, np.int64), np.zeros(last - first, np.int64)
                for a, bounds, crcs, there in feature_crcs(data, offsets):
                    n_words = np.diff(bounds)
                    value = np.where(there, shared.value[crcs % np.uint32(BUCKETS)], 0).sum(0)
                    weight += row_sums(value, np.clip(bounds - a, 0, len(value)))
                n_features = sum(np.maximum(n_words - k, 0) for k in range(GRAMS))
                part = batch.slice(first, last - first)
                drawn = np.array([noise(name) for name in part.column("name").to_pylist()], np.int64)
                columns = [part.column("doc_id"), *map(pa.array, (n_words, n_features, weight, weight + drawn)), part.column("tie")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score", "tie"])

    kind = dict(docs.dtypes)["doc_id"]
    named = docs.select("doc_id", "text", F.col("doc_id").cast("string").alias("name"), F.xxhash64("text").alias("tie"))
    return named.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long, tie long")


KEY = ["below", "nameless", "doc_id", "tie", "row"]


def _key(values: list[Column]) -> Column:
    return F.struct(*(v.alias(c) for c, v in zip(KEY, values, strict=True)))


def select_key(keys: DataFrame, k: int) -> Column:
    """The k-th smallest key (k from 1 to the number of rows) of rows whose columns KEY are unique.

    Each round takes PIVOTS random keys among the rows still in question, counts the rows below and
    at each exactly, and goes on between two of them, until a pivot is the k-th."""
    kinds, key = dict(keys.dtypes), _key([F.col(c) for c in KEY])
    low = high = None
    for turn in range(1 << 20):
        left = keys if low is None else keys.where(key > low)
        left = left if high is None else left.where(key < high)
        drawn = left.select(*KEY).orderBy(F.xxhash64("row", F.lit(turn)), "row").limit(PIVOTS).orderBy(key).collect()
        pivots = [_key([F.lit(r[c]).cast(kinds[c]) for c in KEY]) for r in drawn]
        parts = [f(key, p) for p in pivots for f in (lambda x, p: F.count_if(x < p), lambda x, p: F.count_if(x == p))]
        counts = list(left.agg(*(c.alias(f"c{i}") for i, c in enumerate(parts))).first())
        passed = 0
        for i, pivot in enumerate(pivots):
            under, at = counts[2 * i : 2 * i + 2]
            if k <= under:
                high = pivot
                break
            if k <= under + at:
                return pivot
            low, passed = pivot, under + at
        k -= passed
    raise RuntimeError("keys are not unique")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of `docs` (doc_id, text).

    target: any table with a column `text`. Of the rows with at least `min_words` words `percent` of a hundred, rounded
    down, are drawn and ranked from 1; the rank of others is null. Null and empty texts have no features, weight 0 and
    are never drawn. Rows that repeat a doc_id are drawn each for itself, ordered by a hash of the text;
    a null doc_id draws its noise from the empty name and comes last in ties. Other columns are
    ignored; an empty `docs` gives no rows, an empty target an even distribution.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = scores(docs, gain).withColumns(
        {"below": -F.col("score"), "nameless": F.col("doc_id").isNull(), "row": F.monotonically_increasing_id()}
    )
    scored = materialize(scored, "scores")
    able = F.col("n_words") >= min_words
    k = scored.where(able).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*columns, no_rank)
    drawn = able & (_key([F.col(c) for c in KEY]) <= select_key(scored.where(able), k))
    ranked = numbered(scored.where(drawn), KEY).select(*columns, (F.col("place") + 1).alias("rank"))
    return scored.where(~drawn).select(*columns, no_rank).unionByName(ranked)
