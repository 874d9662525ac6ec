"""One document of each group of near copies: five-word shingles, a Jaccard similarity of 0.8 or more.

Every text gets SKETCH words of 64 bits by SimHash over its distinct shingles. Each word is searched
by the generalised pigeonhole of `simhash`: bits that go together share a part, and a dynamic
programme over estimated candidate counts gives each part a threshold of its own. Two texts at the
least similarity differ in a known share of their bits, hence a plan's chance to bring them together
on some part is known; of the plans with enough of it the cheapest is taken.

Rows of a bucket are compared by all their bits, loosely. What is within the bound and connects a bucket's
rows by the smallest distances (a minimum spanning forest, not all pairs) is a candidate link; the
shingles of its two texts are then compared exactly, so nothing is linked below the similarity.

What this search leaves apart is then searched exactly. Two sets of the similarity share one of their first shingles
in any common order (prefix filter; after Chaudhuri et al., "A primitive operator for similarity joins", ICDE 2006), so
sets of different groups that share such a shingle, and no others, are compared. Rare shingles come first. Sets also differ in
at least as many shingles as the parities of their shingles' places differ in bits (after Sandes et al., "Bitmap filter", TKDE 2020);
where these are too many, no texts are read.
"""

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, comb, floor, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import simhash
from corpusflow.llm.common import BASE, SpanHash, components, documents, min_labels, mix, pieces, utf8, word_spans
from corpusflow.llm.url_filter import bloom_filter, maybe_listed
from corpusflow.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
# Words of a sketch; the pigeonhole's bound on each; the least chance to find a pair at SIMILARITY.
SKETCH = 4
MAX_BITS = 5
RECALL = 0.95
# Candidates may differ in this many standard deviations more bits than a pair at SIMILARITY.
SLACK = 3
CELL_ROWS = 8192
# Counters by which shingles are ordered; pairs made at a time.
COUNTERS = 1 << 18
PAIRS_AT_ONCE = 1 << 18
# Bits of parity for each shingle of a set, least and most; bytes of parities compared at a time.
PARITY, PARITY_BITS = 4, (64, 4096)
_PARITY_BYTES = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORDS = [f"w{k}" for k in range(SKETCH)]


def differing_share(similarity: float) -> float:
    """Share of SimHash bits in which texts of a Jaccard similarity differ: the angle between them."""
    return acos(2 * similarity / (1 + similarity)) / pi


def most_bits(similarity: float) -> int:
    share, bits = differing_share(similarity), simhash.BITS * SKETCH
    return floor(bits * share + SLACK * sqrt(bits * share * (1 - share)))


# ---------------------------------------------------------------- shingles and sketches


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row bounds and hashes of the distinct shingles of each row, sorted; a row of fewer words than
    SHINGLE is one shingle, one without words has none. A-Z are lower-cased."""
    data = _FOLD[data]
    start, end = word_spans(data, offsets)
    bounds = np.searchsorted(start, offsets)
    count = np.diff(bounds)
    row = np.repeat(np.arange(len(count)), count)
    word = SpanHash(data)(start, end)
    found, rows = [], []
    for n in range(1, SHINGLE + 1):
        if n == SHINGLE:
            at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, int)
        else:
            at = bounds[:-1][count == n]
        gram = word[at]
        for k in range(1, n):
            gram = mix(gram + word[at + k] * np.uint64(2 * k + 1))
        found.append(gram + np.uint64(n))
        rows.append(row[at])
    found, rows = np.concatenate(found), np.concatenate(rows)
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    return np.searchsorted(rows[new], np.arange(len(count) + 1)), found[new]


_AT_ONCE = 1 << 13


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH words: a bit is set where over half the shingles have it in that word's remix."""
    votes = np.zeros((SKETCH, simhash.BITS), np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        mixed = mix(hashes[at : at + _AT_ONCE] + np.arange(1, SKETCH + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
        votes += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").reshape(SKETCH, -1, simhash.BITS).sum(1, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def node_of(words: np.ndarray) -> np.ndarray:
    """One number for each sketch (row of words)."""
    out = np.zeros(len(words), np.uint64)
    for k in range(SKETCH):
        out = mix(out + words[:, k])
    return out.view(np.int64)


def set_number(hashes: np.ndarray) -> np.uint64:
    """One number for a set of shingles."""
    with np.errstate(over="ignore"):
        return mix(mix(hashes + np.uint64(BASE)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))[0]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, w0.., node, shingles) for every row of (doc_id, text, key); without words all bits are 0. shingles: the
    number of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in documents(batch):
                bounds, hashes = shingle_sets(data, offsets)
                words = np.array([sketch(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.uint64).reshape(-1, SKETCH)
                part = batch.slice(first, last - first)
                numbers = np.array([set_number(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.uint64)
                columns = [part.column("doc_id"), part.column("key"), *(pa.array(w.view(np.int64)) for w in np.ascontiguousarray(words.T)), pa.array(node_of(words))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers.view(np.int64))], names=["doc_id", "key", *_WORDS, "node", "shingles"])

    kind = dict(docs.dtypes)["doc_id"]
    ddl = ", ".join(f"{w} long" for w in _WORDS)
    return docs.select("doc_id", "text", "key").mapInArrow(run, f"doc_id {kind}, key long, {ddl}, node long, shingles long")


# ---------------------------------------------------------------- candidates

Parts = list[tuple[list[int], int]]


def missed(parts: Parts, share: float) -> float:
    """Chance that two words whose bits differ independently with `share` meet on no part."""
    out = 1.0
    for bits, t in parts:
        out *= 1 - sum(comb(len(bits), k) * share**k * (1 - share) ** (len(bits) - k) for k in range(t + 1))
    return out


def plan(n: int, counts: np.ndarray, similarity: float) -> Parts:
    """The cheapest parts and thresholds of a word among those that find enough of the edge pairs."""
    related, share = simhash.correlation(n, counts), np.diag(counts) / max(n, 1)
    most_missed, options = (1 - RECALL) ** (1 / SKETCH), []
    for m in range(1, MAX_BITS + 2):
        parts = simhash.partition_bits(related, m)
        cost, thresholds = simhash.allocate(parts, share, related, max(n, 1), MAX_BITS)
        used = [(part, t) for part, t in zip(parts, thresholds, strict=True) if t >= 0]
        if missed(used, differing_share(similarity)) <= most_missed or m == MAX_BITS + 1:
            options.append((cost, m, used))
    return min(options, key=lambda x: x[:2])[2]


def _flips(bits: list[int], t: int) -> list[tuple[int, int]]:
    """(bits to flip, the highest of them) of up to t bits of a part."""
    return [(sum(1 << b for b in some), max(some)) for k in range(1, t + 1) for some in combinations(bits, k)]


def file_and_probe(classes: DataFrame, plans: list[Parts]) -> DataFrame:
    """(bucket, role, w0..): role 0 is a sketch's own bucket of a part, 1 one within the threshold. Of two
    sketches whose parts differ, only that with a 0 in the highest differing bit probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(w) for w in _WORDS]
            for k, parts in enumerate(plans):
                word = columns[k].to_numpy().view(np.uint64)
                for i, (bits, t) in enumerate(parts):
                    tag = mix(np.array([k * simhash.BITS + i], np.uint64))
                    own = word & np.uint64(sum(1 << b for b in bits))
                    for flip, top in [(0, None), *_flips(bits, t)]:
                        some = np.arange(len(word)) if top is None else np.flatnonzero((word >> np.uint64(top)) & np.uint64(1) == 0)
                        bucket = mix((own[some] ^ np.uint64(flip)) + tag).view(np.int64)
                        role = np.full(len(some), flip != 0, np.int8)
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(role), *(c.take(pa.array(some)) for c in columns)], names=["bucket", "role", *_WORDS])

    ddl = ", ".join(f"{w} long" for w in _WORDS)
    return classes.select(*_WORDS).mapInArrow(run, f"bucket long, role byte, {ddl}")


def cells(filed: DataFrame, row: list[str] = _WORDS) -> DataFrame:
    """Adds `cell`. A bucket above CELL_ROWS is cut into chunks by the columns `row`, and each pair of chunks is
    a cell of its own, so that every pair of its rows still meets."""
    large = filed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    large = materialize(large.withColumn("k", F.ceil(F.col("n") / CELL_ROWS).cast("int")).drop("n"), "buckets")
    if large.isEmpty():
        return filed.withColumn("cell", F.lit(0))
    cut = filed.join(large, "bucket", "left")
    k = F.coalesce("k", F.lit(1))
    chunk = F.pmod(F.xxhash64(*row), k).cast("int")
    return cut.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda other: F.least(chunk, other) * k + F.greatest(chunk, other)))).drop("k")


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Positions of the links a-b between n nodes that make a minimum spanning forest (Boruvka)."""
    order = np.lexsort((b, a, weight))
    a, b, label = a[order], b[order], np.arange(n)
    chosen = []
    left = np.arange(len(a))
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return order[np.concatenate(chosen)] if chosen else order[:0]
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[left]], left)
        np.minimum.at(best, label[b[left]], left)
        some = np.unique(best[best < len(a)])
        chosen.append(some)
        label = min_labels(label[a[some]], label[b[some]], n)[label]


def candidate_links(end: np.ndarray, role: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within `most` bits that span what they link within each run; end: where each row's run ends."""
    index = np.arange(len(words))
    active = index[(role == 0) & (index + 1 < end)]
    a, b, w, found, ahead = [], [], [], 0, 1

    def spanning() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, z = (np.concatenate(c) for c in (a, b, w))
        some = forest(x, y, z, len(words))
        return x[some], y[some], z[some]

    while len(active):
        other = active + ahead
        bits = np.bitwise_count(words[active, 0] ^ words[other, 0]).astype(np.int64)
        near = np.flatnonzero(bits <= most)
        bits = bits[near]
        for k in range(1, SKETCH):
            bits = bits + np.bitwise_count(words[active[near], k] ^ words[other[near], k])
            near, bits = near[bits <= most], bits[bits <= most]
        if len(near):
            a.append(active[near])
            b.append(other[near])
            w.append(bits)
            found += len(near)
        if found > PAIRS_AT_ONCE:
            x, y, z = spanning()
            a, b, w, found = [x], [y], [z], len(x)
        ahead += 1
        active = active[active + ahead < end[active]]
    if not found:
        return index[:0], index[:0]
    x, y, _ = spanning()
    return x, y


def by_runs(compare: Callable[[pa.Table], Iterator[pa.RecordBatch]], *names: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`compare` of tables that hold whole runs of equal values in `names`, by which the rows are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            # The last run may go on in the next batch.
            last = np.ones(len(rows), bool)
            for c in names:
                values = rows.column(c).to_numpy()
                last &= values == values[-1]
            first = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
            if first:
                yield from compare(rows.slice(0, first))
            rest = rows.slice(first)
        if rest is not None:
            yield from compare(rest)

    return run


def candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """(u, v): nodes of classes (w0.., node) to compare, each pair once."""
    plans = []
    for w in _WORDS:
        n, counts = simhash.bit_counts(classes.select(F.col(w).alias("fp")))
        plans.append(plan(n, counts, similarity))
    most = most_bits(similarity)
    filed = cells(file_and_probe(classes, plans)).repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "role")

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, cell, role = (rows.column(c).to_numpy() for c in ("bucket", "cell", "role"))
        words = np.stack([rows.column(w).to_numpy() for w in _WORDS], axis=1).view(np.uint64)
        new = np.append(0, np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1)
        end = np.repeat(np.append(new[1:], len(bucket)), np.diff(np.append(new, len(bucket))))
        a, b = candidate_links(end, role, words, most)
        node = node_of(words)
        u, v = np.maximum(node[a], node[b]), np.minimum(node[a], node[b])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return filed.mapInArrow(by_runs(compare, "bucket", "cell"), "u long, v long").where("u != v").distinct()


# ---------------------------------------------------------------- exact links and the choice


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data_u, ends_u), (data_v, ends_v) = (utf8(batch.column(c)) for c in ("text_u", "text_v"))
            keep = []
            # As many pairs at a time as both texts have bytes for.
            for first, last in pieces(ends_u + ends_v):
                sets = []
                for data, ends in ((data_u, ends_u), (data_v, ends_v)):
                    bounds, hashes = shingle_sets(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
                    sets.append([hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
                for a, b in zip(*sets, strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the first rows of some classes (node), which are unique; rows that come twice come twice. Their texts
    alone are moved: a Bloom filter of the first rows' keys lets few others pass on to the join."""
    first = classes.join(nodes, "node").select("node", "first.doc_id", "first.key")
    first = materialize(first.withColumnsRenamed({"doc_id": "first_id", "key": "first_key"}), "linked")
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(first.select(F.xxhash64("first_id", "first_key").alias("key"))))

    @F.pandas_udf("boolean")
    def passes(key: pd.Series) -> pd.Series:
        return pd.Series(maybe_listed(key.to_numpy(np.int64), shared.value))

    some = docs.where(passes(F.xxhash64("doc_id", "key")))
    return some.join(first, some["doc_id"].eqNullSafe(first["first_id"]) & (some["key"] == first["first_key"])).select("node", "text")


def exact_links(links: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The candidate links (u, v) whose texts reach the similarity. Texts of linked classes alone are moved."""
    linked = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    texts = materialize(texts_of(linked, classes, docs).dropDuplicates(["node"]), "linked-texts")
    sides = links.join(texts.toDF("u", "text_u"), "u").join(texts.toDF("v", "text_v"), "v")
    return sides.mapInArrow(_similar(similarity), "u long, v long")


# ---------------------------------------------------------------- what the sketches leave apart


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences in `docs` (text) of the shingles of each of COUNTERS slots of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, data, offsets in documents(batch):
                total += np.bincount((shingle_sets(data, offsets)[1] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])

    found = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    counts = np.zeros(COUNTERS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts


def prefixes(docs: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """(shingles, first): of each row of `docs` (text) with words the number of its set, and as many of its rarest
    shingles that a set of the similarity has one of them among its own."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in documents(batch):
                bounds, hashes = shingle_sets(data, offsets)
                size = np.diff(bounds)
                row = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((hashes, shared.value[(hashes % np.uint64(COUNTERS)).astype(np.int64)], row))
                # Least number of common shingles, not too high by rounding.
                common = np.ceil(similarity * size * (1 - 1e-12)).astype(np.int64)
                most = size - common + 1
                kept = np.arange(len(row)) - bounds[row] < most[row]
                some = np.flatnonzero(size)
                ends = np.append(0, np.cumsum(most[some]))
                numbers = np.array([set_number(hashes[bounds[i] : bounds[i + 1]]) for i in some], np.uint64)
                first = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[order][kept].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(numbers.view(np.int64)), first], names=["shingles", "first"])

    return docs.select("text").mapInArrow(run, "shingles long, first array<long>")


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each place of a set's shingles: whether their number there is odd. Places are as many as a power of two; half
    as many are had by folding the halves together."""
    least, most = PARITY_BITS
    width = min(max(1 << int(PARITY * len(hashes) - 1).bit_length(), least), most) if len(hashes) else least
    place = (hashes & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def with_parities(texts: DataFrame) -> DataFrame:
    """(node, n, bits): size and parities of the sets of (node, text), each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in documents(batch):
                bounds, hashes = shingle_sets(data, offsets)
                bits = [parities(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [batch.column("node").slice(first, last - first), pa.array(np.diff(bounds), pa.int32()), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, n int, bits binary").dropDuplicates(["node"])


class Parities:
    """Parities of many sets, to be compared by pairs."""

    def __init__(self, bits: pa.BinaryArray):
        where = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1]
        self._width = np.diff(where).astype(np.int64)
        # Sets of one width are rows of one array.
        self._place, self._sets = np.zeros(len(bits), np.int64), {}
        for wide in np.unique(self._width).tolist():
            rows = np.flatnonzero(self._width == wide)
            self._place[rows] = np.arange(len(rows))
            self._sets[wide] = np.frombuffer(bits.take(pa.array(rows)).buffers()[2], np.uint64, len(rows) * wide // 8).reshape(len(rows), -1)

    def _of(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Of some rows, folded to so many bytes."""
        out = np.empty((len(rows), width // 8), np.uint64)
        for wide in np.unique(self._width[rows]).tolist():
            some = np.flatnonzero(self._width[rows] == wide)
            found = self._sets[wide][self._place[rows[some]]]
            while found.shape[1] > width // 8:
                half = found.shape[1] // 2
                found = found[:, :half] ^ found[:, half:]
            out[some] = found
        return out

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits rows a and b differ: no more than in shingles."""
        width, bits = np.minimum(self._width[a], self._width[b]), np.zeros(len(a), np.int64)
        for narrow in np.unique(width).tolist():
            some = np.flatnonzero(width == narrow)
            for at in range(0, len(some), _PARITY_BYTES // narrow):
                part = some[at : at + _PARITY_BYTES // narrow]
                bits[part] = np.bitwise_count(self._of(a[part], narrow) ^ self._of(b[part], narrow)).sum(1, dtype=np.int64)
        return bits


def crossing_pairs(
    end: np.ndarray, root: np.ndarray, number: np.ndarray, size: np.ndarray, similarity: float, parity: Parities | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of numbers, at most about PAIRS_AT_ONCE at a time, of the rows of one run that have different roots, and sizes and
    parities that allow for the similarity. Rows of a run are sorted by root; end: where each row's run ends."""
    index = np.arange(len(root))
    new = np.append(True, (root[1:] != root[:-1]) | (end[1:] != end[:-1])) if len(root) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    after = np.append(starts[1:], len(root))[np.cumsum(new) - 1]  # where the rows of the own root end
    count = end - after
    done = np.append(0, np.cumsum(count))
    at = 0
    while at < len(root):
        to = max(int(np.searchsorted(done, done[at] + PAIRS_AT_ONCE, "right")) - 1, at + 1)
        n = count[at:to]
        a = np.repeat(index[at:to], n)
        b = np.repeat(after[at:to], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) * (1 - 1e-12)
        a, b = a[near], b[near]
        if parity is not None:
            near = parity.differ(a, b) <= (size[a] + size[b]) * ((1 - similarity) / (1 + similarity) * (1 + 1e-12))
            a, b = a[near], b[near]
        u, v = number[a], number[b]
        pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
        yield pairs[0], pairs[1]
        at = to


def sharing_sets(docs: DataFrame, similarity: float) -> DataFrame:
    """(bucket, node): sets (numbers) that have one of their first shingles in common, once for all shingles that the same sets
    have. A set alone with a shingle has no row."""
    rows = prefixes(docs, shingle_counts(docs), similarity).dropDuplicates(["shingles"])
    rows = rows.select(F.explode("first").alias("shingle"), F.col("shingles").alias("node"))
    dealt = rows.repartition("shingle").sortWithinPartitions("shingle")

    def several(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        shingle, node = (rows.column(c).to_numpy() for c in ("shingle", "node"))
        new = np.append(0, np.flatnonzero(shingle[1:] != shingle[:-1]) + 1)
        length = np.diff(np.append(new, len(shingle)))
        # Of equal buckets the sets are put together, so a chance hit adds pairs and loses none.
        bucket = mix(np.add.reduceat(mix(node.view(np.uint64) + np.uint64(BASE)), new) + length.astype(np.uint64)).view(np.int64)
        shared = np.repeat(length > 1, length)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket, length)[shared]), pa.array(node[shared])], names=["bucket", "node"])

    return dealt.mapInArrow(by_runs(several, "shingle"), "bucket long, node long").distinct()


def missed_pairs(docs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): sets of different roots that may have the similarity, each pair once. sets: (node, first, root), unique."""
    shared = materialize(sharing_sets(docs, similarity), "sharing")
    known = with_parities(texts_of(shared.select("node").distinct(), sets, docs)).join(sets.select("node", "root"), "node")
    rows = cells(shared, ["node"]).join(known, "node")
    dealt = rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "root")

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, cell, root, number, size = (rows.column(c).to_numpy() for c in ("bucket", "cell", "root", "node", "n"))
        new = np.append(0, np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1)
        length = np.diff(np.append(new, len(bucket)))
        parity = Parities(rows.column("bits").combine_chunks().cast(pa.binary()))
        for u, v in crossing_pairs(np.repeat(new + length, length), root, number, size, similarity, parity):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.mapInArrow(by_runs(compare, "bucket", "cell"), "u long, v long").distinct()


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def _order(doc_id: str | Column, key: str | Column) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.struct(doc_id.isNull().alias("nameless"), doc_id.alias("doc_id"), F.col(key).alias("key") if isinstance(key, str) else key)


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(root, doc_id, key): the first document of each group of near copies of (doc_id, text, key).

    A group is connected by links of the similarity; its first document has the smallest doc_id, and of
    several texts of that doc_id the smallest key. A null doc_id comes last."""
    rows = materialize(sketches(docs), "sketches")
    classes = rows.groupBy("node", *_WORDS).agg(F.min(_order("doc_id", "key")).alias("first"))
    classes = materialize(classes, "classes")
    links = materialize(candidates(classes, similarity), "candidates")
    roots = components(materialize(exact_links(links, classes, docs, similarity), "links"))
    rooted = classes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted, "rooted")
    # Every set of shingles with its root; sets of one class have one.
    sets = rows.groupBy(F.col("shingles").alias("node")).agg(F.min(_order("doc_id", "key")).alias("first"), F.min("node").alias("class"))
    sets = materialize(sets.join(rooted.select(F.col("node").alias("class"), "root"), "class").drop("class"), "sets")
    missed = materialize(missed_pairs(docs, sets, similarity), "missed")
    more = exact_links(missed, sets, docs, similarity)
    for side in ("u", "v"):
        more = more.join(sets.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side)
    joined = components(materialize(more.select("u_root", "v_root"), "more-links"), "u_root", "v_root").toDF("root", "whole")
    rooted = rooted.join(joined, "root", "left").withColumn("root", F.coalesce("whole", "root"))
    return rooted.groupBy("root").agg(F.min("first").alias("first")).select("root", "first.doc_id", "first.key")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The first document of each group of near copies, with all its columns.

    Rows with the same doc_id and text are one document, of which one row stays; rows of one doc_id with different
    texts are documents of their own, and so are rows without doc_id. Null, empty and blank texts
    have no shingles and are copies of each other; a text of fewer than five words is one shingle, and a copy of
    texts with just that. Texts of equal sketches (256 bits) are one class; no other pair of the similarity is left out.
    An empty table gives no rows.
    """
    key = _free(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    chosen = near_groups(keyed.select("doc_id", "text", F.col(key).alias("key")), similarity)
    chosen = materialize(chosen.select(F.col("doc_id").alias("chosen_id"), F.col("key").alias("chosen_key")), "chosen")
    same = keyed["doc_id"].eqNullSafe(chosen["chosen_id"]) & (keyed[key] == chosen["chosen_key"])
    return keyed.join(chosen, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
