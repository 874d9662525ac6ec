"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping probes of at most PROBE bytes. A region of a document
within k edits of a probe of n bytes shares at least n - q + 1 - k * q of its q-grams, all on
diagonals (position in the document minus position in the probe) that lie within k of each other.
Shared q-grams are counted in overlapping diagonal bands; bands that meet the bound are verified by
banded alignment. So every region within the edit budget of a probe is found, and nothing else. A short
probe for which the bound would ask for no shared q-gram has a smaller q, the largest for which it asks for one.

Shared q-grams are counted HITS_AT_ONCE at a time in the order of their positions, and bands that lie behind are
verified and forgotten: a text and a probe that repeat the same few q-grams take time but no more memory.

Texts are compared as UTF-8 with A-Z lower-cased and ASCII blanks as spaces. The benchmark is a
query set: tasks cut it into probes and index them in blocks of bounded size, the driver passes
on one block after the other, and each is matched against all documents in one pass without a shuffle.
"""

import pickle

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusflow.llm.common import SpanHash, documents, rows_of
from corpusflow.session import materialize

Q = 10
PROBE = 120
STRIDE = 60
# Edits allowed per 100 bytes of a probe.
BUDGET = 8
# Items of fewer bytes identify no leak.
MIN_BYTES = 10
# Bytes of probes that are indexed together, and shared q-grams that are held at once.
BLOCK_BYTES = 1 << 20
HITS_AT_ONCE = 1 << 19
_GATE_BITS = 22
_ALIGN_AT_ONCE = 4096
_PAD = 255

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[9, 10, 11, 12, 13]] = 32


def edit_budget(n: np.ndarray | int) -> np.ndarray | int:
    return n * BUDGET // 100


def gram_size(n: np.ndarray) -> np.ndarray:
    """The q of a probe of n bytes: at most Q, and so that n - q + 1 - k * q is at least 1."""
    return np.minimum(Q, n // (edit_budget(n) + 1))


def cut(text: str | None) -> Iterator[np.ndarray]:
    """The probes of an item, each once."""
    folded = FOLD[np.frombuffer((text or "").encode(), np.uint8)]
    if len(folded) < MIN_BYTES:
        return
    last, seen = max(0, len(folded) - PROBE), set()
    for start in (*range(0, last, STRIDE), last):
        part = folded[start : start + PROBE]
        if part.tobytes() not in seen:
            seen.add(part.tobytes())
            yield part


class Grams:
    """The q-grams of the probes of one q, sorted by hash, with their places."""

    def __init__(self, q: int, texts: list[np.ndarray], numbers: np.ndarray):
        self.q = q
        hashes = [SpanHash(text).grams(q) for text in texts]
        sizes = np.array([len(g) for g in hashes])
        grams, probe = np.concatenate(hashes), np.repeat(numbers, sizes)
        at = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(grams, kind="stable")
        self.probe, self.at = probe[order].astype(np.int32), at[order].astype(np.int32)
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[self._slot(self.grams)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - _GATE_BITS)).astype(np.int64)

    def shared(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the q-grams that some probe has, and their numbers among the distinct ones."""
        where = np.flatnonzero(self.gate[self._slot(grams)])
        slot = np.minimum(np.searchsorted(self.grams, grams[where]), len(self.grams) - 1)
        same = self.grams[slot] == grams[where]
        return where[same], slot[same]


class Probes:
    """One block of probes: the item of each, its bytes, and an index of q-grams for each q."""

    def __init__(self, item: list, texts: list[np.ndarray]):
        self.item = item
        self.length = np.array([len(t) for t in texts], np.int64)
        self.budget, self.q = edit_budget(self.length), gram_size(self.length)
        self.least = self.length - self.q + 1 - self.budget * self.q
        self.bytes = np.full((len(texts), PROBE), _PAD, np.uint8)
        for i, text in enumerate(texts):
            self.bytes[i, : len(text)] = text
        self.parts = [Grams(q, [texts[i] for i in np.flatnonzero(self.q == q)], np.flatnonzero(self.q == q)) for q in np.unique(self.q).tolist()]

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> "Probes":
        cuts = [(item_id, part) for item_id, text in items for part in cut(text)]
        return cls([i for i, _ in cuts], [t for _, t in cuts])

    def to_bytes(self) -> bytes:
        return pickle.dumps(vars(self) | {"parts": [vars(g) for g in self.parts]})

    @classmethod
    def from_bytes(cls, data: bytes) -> "Probes":
        new = cls.__new__(cls)
        vars(new).update(pickle.loads(data))
        parts, new.parts = new.parts, []
        for values in parts:
            part = Grams.__new__(Grams)
            vars(part).update(values)
            new.parts.append(part)
        return new


def align(patterns: np.ndarray, texts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each whole pattern and a part of its text inside a band, and the band
    offset at which that part ends.

    Row i of the dynamic programme holds the costs of matching i bytes of the pattern to text ending
    at i + b for each band offset b; `start` has row 0.
    """
    cost, width = start.astype(np.int32), start.shape[1]
    step = np.arange(width, dtype=np.int32)
    for i in range(patterns.shape[1]):
        change = cost + (texts[:, i : i + width] != patterns[:, i : i + 1])
        change[:, :-1] = np.minimum(change[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(change - step, axis=1) + step
    best = cost.argmin(axis=1)
    return cost[np.arange(len(cost)), best], best


def _gather(data: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """`width` bytes from `first` on (or before it, backwards); outside [low, high) is padding."""
    at = first[:, None] + (-1 - np.arange(width) if back else np.arange(width))
    inside = (at >= low[:, None]) & (at < high[:, None])
    return np.where(inside, data[np.clip(at, 0, len(data) - 1)], _PAD)


def bands(folded: np.ndarray, offsets: np.ndarray, probes: Probes, grams: Grams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row * probes + probe, band) of all bands with enough shared q-grams."""
    row, q, count_of = rows_of(offsets), grams.q, len(probes.length)
    where, slot = grams.shared(SpanHash(folded).grams(q))
    inside = row[where] == row[where + q - 1]
    where, slot = where[inside], slot[inside]
    count = grams.first[slot + 1] - grams.first[slot]
    total = np.cumsum(count)
    most = np.int64(len(folded) + 2 * PROBE + 2)
    keys, numbers, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while at < len(where):
        to = max(at + 1, int(np.searchsorted(total, total[at] - count[at] + HITS_AT_ONCE, "right")))
        n, first = count[at:to], grams.first[slot[at:to]]
        place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        pos, probe = np.repeat(where[at:to], n), grams.probe[place].astype(np.int64)
        # Diagonals relative to the row, made positive; each lies in two overlapping bands.
        band = (pos - offsets[row[pos]] - grams.at[place] + PROBE) // (probes.budget[probe] + 1)
        key = (row[pos] * count_of + probe) * most + band
        new, n = np.unique(np.concatenate([key, key[band > 0] - 1]), return_counts=True)
        keys, which = np.unique(np.concatenate([keys, new]), return_inverse=True)
        numbers = np.bincount(which, np.concatenate([numbers, n]), len(keys)).astype(np.int64)
        at = to
        # A band ends where its last diagonal meets the end of the probe.
        pair, band = keys // most, keys % most
        probe = pair % count_of
        end = offsets[pair // count_of] + (band + 2) * (probes.budget[probe] + 1) - PROBE + probes.length[probe] - q
        behind = end < where[at] if at < len(where) else np.ones(len(keys), bool)
        good = behind & (numbers >= probes.least[probe])
        yield pair[good], band[good]
        keys, numbers = keys[~behind], numbers[~behind]


def regions(data: np.ndarray, offsets: np.ndarray, probes: Probes) -> list[tuple[int, int, int, int, int]]:
    """(row, probe, start byte, end byte, edits) of all verified regions of all rows."""
    folded = FOLD[data]
    return [found for g in probes.parts if len(data) >= g.q for some in bands(folded, offsets, probes, g) for found in verified(folded, offsets, probes, *some)]


def verified(folded: np.ndarray, offsets: np.ndarray, probes: Probes, pair: np.ndarray, band: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Those of the bands in which the probe is aligned within its budget, as regions."""
    probe = pair % max(len(probes.length), 1)
    out = []
    for n in np.unique(probes.length[probe]):
        of = np.flatnonzero(probes.length[probe] == n)
        k = int(edit_budget(n))
        for some in np.array_split(of, len(of) // _ALIGN_AT_ONCE + 1):
            r, p = pair[some] // len(probes.length), probe[some]
            low, high = offsets[r], offsets[r + 1]
            # The band has 2 (k + 1) diagonals, and a path leaves it by at most k.
            base = low + band[some] * (k + 1) - PROBE - k
            width = 2 * (k + 1) + 2 * k
            pattern = probes.bytes[p, :n]
            edits, best = align(pattern, _gather(folded, low, high, base, n + width), np.zeros((len(some), width)))
            ok = edits <= k
            r, p, low, high, edits = r[ok], p[ok], low[ok], high[ok], edits[ok]
            end = np.minimum(base[ok] + n + best[ok], high)
            start = np.full((len(end), 2 * k + 1), 1 << 20)
            start[:, k:] = np.arange(k + 1)
            back = _gather(folded, low, high, end + k, n + 2 * k + 1, back=True)
            _, best = align(pattern[ok][:, ::-1], back, start)
            begin = np.maximum(end - (n + best - k), low)
            out += zip(r.tolist(), p.tolist(), (begin - low).tolist(), (end - low).tolist(), edits.tolist(), strict=True)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            parts = [p.tobytes() for p in cut(text)]
            if parts:
                items = batch.column("item_id").take(pa.array([i] * len(parts)))
                yield pa.RecordBatch.from_arrays([items, pa.array(parts, pa.binary())], names=["item_id", "probe"])


def _indexed(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("item_id", "ascending"), ("probe", "ascending")])
    index = Probes(rows.column("item_id").to_pylist(), [np.frombuffer(p, np.uint8) for p in rows.column("probe").to_pylist()])
    return pa.table({"block": rows.column("block")[:1].cast(pa.int32()), "index": pa.array([index.to_bytes()], pa.binary())})


def blocks(benchmark: DataFrame) -> Iterator[Probes]:
    """Indexes of all probes of the items, BLOCK_BYTES of probes in each. Tasks cut, deal and index the probes; the
    driver holds one block at a time."""
    kind = dict(benchmark.dtypes)["item_id"]
    probes = benchmark.select("item_id", "text").mapInArrow(_cut, f"item_id {kind}, probe binary").distinct()
    probes = materialize(probes, "probes")
    size = probes.agg(F.sum(F.octet_length("probe")).alias("n")).first().n or 0
    n = -(-size // BLOCK_BYTES)
    dealt = probes.withColumn("block", F.pmod(F.xxhash64("item_id", "probe"), F.lit(max(n, 1))).cast("int"))
    indexed = materialize(dealt.groupBy("block").applyInArrow(_indexed, "block int, index binary"), "probe-blocks")
    for block in range(n):
        for row in indexed.where(F.col("block") == block).collect():
            yield Probes.from_bytes(row["index"])
    if not n:
        yield Probes([], [])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits, probes): regions of `docs` (doc_id, text) within the edit
    budget of a probe of `benchmark` (item_id, text).

    start and end count code points, end exclusive; overlapping regions of an item are one, edits is
    the fewest of its `probes` regions. Null and empty texts match nothing, items of fewer than MIN_BYTES
    bytes match nothing, repeated items count once, null ids are carried along, a repeated row gives its regions again, other
    columns are ignored.
    """
    spark, ids = docs.sparkSession, f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    names = ["doc_id", "item_id", "start", "end", "edits", "probes"]
    found = None
    for probes in blocks(benchmark):
        shared = spark.sparkContext.broadcast(probes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for first, _, data, offsets in documents(batch):
                    rows, points = [], np.cumsum(np.append(0, (data & 0xC0) != 0x80))
                    spans = sorted((r, str(index.item[p]), s, e, d, index.item[p]) for r, p, s, e, d in regions(data, offsets, index))
                    for r, name, s, e, d, item in spans:
                        last = rows[-1] if rows else None
                        if last and last[:2] == [r, name] and s <= last[4]:
                            rows[-1] = [r, name, item, last[3], max(last[4], e), min(last[5], d), last[6] + 1]
                        else:
                            rows.append([r, name, item, s, e, d, 1])
                    if rows:
                        r = np.array([x[0] for x in rows])
                        at = [points[offsets[r] + [x[i] for x in rows]] - points[offsets[r]] for i in (3, 4)]
                        columns = [batch.column("doc_id").take(pa.array(first + r)), pa.array([x[2] for x in rows], item_type), *map(pa.array, at)]
                        columns += [pa.array([x[i] for x in rows], pa.int64()) for i in (5, 6)]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

        part = docs.select("doc_id", "text").mapInArrow(run, f"{ids}, start long, end long, edits long, probes long")
        part = materialize(part, "leaks")
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without any region of the benchmark, with all their columns.

    Rows are judged each by its text: null and empty texts stay, as do repeated rows and rows without doc_id that
    hold no region. An empty table, or a benchmark without items of MIN_BYTES bytes, changes nothing."""
    for probes in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(probes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, data, offsets in documents(batch):
                    clean = np.ones(last - first, bool)
                    clean[[r for r, *_ in regions(data, offsets, shared.value)]] = False
                    yield batch.slice(first, last - first).filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
