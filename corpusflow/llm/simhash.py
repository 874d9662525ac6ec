"""SimHash near-duplicates by the generalised pigeonhole principle.

Every text gets a fingerprint of 64 bits. Two fingerprints of at most `max_bits` different bits are
found exactly: the bits are divided into parts, part i gets a threshold t_i, and if the thresholds
add up to max_bits - parts + 1, two such fingerprints differ in at most t_i bits on some part i.
Correlated bits share a part, so that parts differ in selectivity; the number of parts and the
thresholds (-1 leaves a part out) are the cheapest by dynamic programming over estimated candidate
counts. A fingerprint is filed in one bucket per part and probes the buckets within its threshold.

Fingerprints, not documents, are compared: copies of a text are one class. Buckets of any size are
compared in cells of bounded size, and a task emits a spanning forest of its links, not all pairs.
"""

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import components, documents, min_labels, mix
from corpusflow.session import materialize

BITS = 64
SEED = 42
# Rows of a cell in which fingerprints are compared.
CELL_ROWS = 8192
# Estimated costs in seconds of a row that is shuffled, its disk included, and of a comparison.
ROW_COST, COMPARE_COST = 3e-5, 5e-9
HASHES_AT_ONCE = 1 << 16


def shingles(text: bytes, words: int) -> tuple[bytes, list[int], list[int]]:
    """The lower-cased words joined by single spaces, and where each shingle starts and ends."""
    found = text.lower().split()
    ends = np.cumsum([len(w) + 1 for w in found], dtype=np.int64) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    if len(found) > words:
        return b" ".join(found), starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    return b" ".join(found), [0][: len(found)], [int(ends[-1])] if found else []


def fingerprint(text: bytes, words: int) -> int:
    """Fingerprint of one text: a bit is set where over half the shingles' hashes have it."""
    joined, starts, ends = shingles(text, words)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), HASHES_AT_ONCE):
        to = at + HASHES_AT_ONCE
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:to], ends[at:to], strict=True)], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) for every row; a null or wordless text has zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in documents(batch):
                whole = data.tobytes()
                found = [fingerprint(whole[a:b], words) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                ids = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int64())], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def bit_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have each pair of bits set; summed by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            words = batch["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(words, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.float64)
            n += len(bits)
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": [*i.ravel(), BITS], "j": [*j.ravel(), BITS], "n": [*total.ravel().astype(np.int64), n]})

    counts = np.zeros((BITS + 1, BITS + 1))
    for row in classes.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        counts[row.i, row.j] = row.n
    return int(counts[BITS, BITS]), counts[:BITS, :BITS]


def correlation(n: int, counts: np.ndarray) -> np.ndarray:
    share = np.diag(counts) / max(n, 1)
    spread = np.sqrt(share * (1 - share))
    product = np.outer(spread, spread)
    joint = counts / max(n, 1) - np.outer(share, share)
    return np.divide(joint, product, out=np.zeros_like(joint), where=product > 0)


def partition_bits(related: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each grows by the bit most correlated with those it has."""
    strength, free, out = np.abs(related), set(range(BITS)), []
    for i in range(parts):
        width = BITS // parts + (i < BITS % parts)
        part = [max(sorted(free), key=lambda b: strength[b, sorted(free)].sum())]
        free.remove(part[0])
        while len(part) < width:
            best = max(sorted(free), key=lambda b: strength[b, part].sum())
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def near_share(part: list[int], share: np.ndarray, related: np.ndarray, most: int) -> list[float]:
    """Estimated share of fingerprint pairs within 0..most bits on a part. Correlated bits count as
    fewer independent ones."""
    width = len(part)
    r = related[np.ix_(part, part)]
    extra = (np.square(r).sum() - np.square(np.diag(r)).sum()) / max(width, 1)
    free = max(1, round(width / (1 + extra)))
    differ = float(np.mean(2 * share[part] * (1 - share[part])))
    spread = [comb(free, k) * differ**k * (1 - differ) ** (free - k) for k in range(most + 1)]
    return np.cumsum(spread).tolist()


def allocate(parts: list[list[int]], share: np.ndarray, related: np.ndarray, n: int, max_bits: int) -> tuple[float, list[int]]:
    """The cheapest thresholds that add up to max_bits - len(parts) + 1."""
    goal = max_bits + 1  # thresholds are counted from -1, so they add up to this
    best = {0: (0.0, [])}
    for part in parts:
        near = near_share(part, share, related, max_bits)
        costs = [0.0]
        for t in range(min(max_bits, len(part)) + 1):
            rows = sum(comb(len(part), k) for k in range(t + 1))
            costs.append(n * rows * ROW_COST + near[t] * n * n / 2 * COMPARE_COST)
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for extra, more in enumerate(costs):
                if used + extra <= goal and (used + extra not in step or cost + more < step[used + extra][0]):
                    step[used + extra] = (cost + more, [*chosen, extra - 1])
        best = step
    return best[goal]


def plan(n: int, counts: np.ndarray, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts in use."""
    related, share = correlation(n, counts), np.diag(counts) / max(n, 1)
    options = []
    for m in range(1, min(max_bits + 2, 13)):
        parts = partition_bits(related, m)
        cost, thresholds = allocate(parts, share, related, max(n, 1), max_bits)
        options.append((cost, m, list(zip(parts, thresholds, strict=True))))
    return [(part, t) for part, t in min(options, key=lambda x: x[:2])[2] if t >= 0]


def file_and_probe(classes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, bucket, role, node, fp): role 0 is the fingerprint's own bucket, 1 one that it probes."""
    own = [sum(1 << b for b in bits) for bits, _ in parts]
    flips = [[sum(1 << b for b in some) for k in range(t + 1) for some in combinations(bits, k)] for bits, t in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (mask, some) in enumerate(zip(own, flips, strict=True)):
                for k, flip in enumerate(some):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(fp), i, np.int32)),
                            pa.array(((fp & np.uint64(mask)) ^ np.uint64(flip)).view(np.int64)),
                            pa.array(np.full(len(fp), k > 0, np.int32)),
                            batch.column("node"),
                            batch.column("fp"),
                        ],
                        names=["part", "bucket", "role", "node", "fp"],
                    )

    return classes.select("node", "fp").mapInArrow(run, "part int, bucket long, role int, node long, fp long")


def cells(filed: DataFrame) -> DataFrame:
    """Adds `cell`. A bucket above CELL_ROWS is cut into k chunks, and each pair of chunks is a cell
    of its own, so that every pair of its rows still meets."""
    filed = filed.withColumn("cell", F.lit(0))
    large = filed.groupBy("part", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    large = materialize(large.withColumn("k", F.ceil(F.col("n") / CELL_ROWS).cast("int")).drop("n"), "buckets")
    if large.isEmpty():
        return filed
    cut = filed.join(large, ["part", "bucket"], "left")
    k, chunk = F.coalesce("k", F.lit(1)), F.pmod(F.xxhash64("node"), F.coalesce("k", F.lit(1))).cast("int")
    cell = lambda other: F.least(chunk, other) * k + F.greatest(chunk, other)
    return cut.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), k - 1), cell))).drop("k")


def links_of(end: np.ndarray, role: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within runs of rows; end: where each row's run ends."""
    index = np.arange(len(fp))
    active = index[(role == 0) & (index + 1 < end)]
    a, b, found, ahead = [], [], 0, 1
    while len(active):
        other = active + ahead
        near = np.flatnonzero(np.bitwise_count(fp[active] ^ fp[other]) <= max_bits)
        if len(near):
            a.append(active[near])
            b.append(other[near])
            found += len(near)
        if found > 1 << 20:
            label = min_labels(np.concatenate(a), np.concatenate(b), len(fp))
            a, b = [np.flatnonzero(label != index)], [label[label != index]]
            found = len(a[0])
        ahead += 1
        active = active[active + ahead < end[active]]
    if not found:
        return index[:0], index[:0]
    label = min_labels(np.concatenate(a), np.concatenate(b), len(fp))
    return index[label != index], label[label != index]


def near_links(classes: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): links of `classes` (node, fp) that connect all fingerprints within `max_bits`."""
    n, counts = bit_counts(classes)
    parts = plan(n, counts, max_bits)
    order = ["part", "bucket", "cell"]
    filed = cells(file_and_probe(classes, parts))
    filed = filed.repartition(*order).sortWithinPartitions(*order, "role")

    def compare(rows: pa.Table) -> pa.RecordBatch:
        columns = {c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("part", "bucket", "cell", "role", "node", "fp")}
        new = np.zeros(len(rows), bool)
        for c in order:
            new[1:] |= columns[c][1:] != columns[c][:-1]
        bounds = np.append(np.flatnonzero(new), len(rows))
        end = bounds[np.searchsorted(bounds, np.arange(len(rows)), "right")]
        a, b = links_of(end, columns["role"], columns["fp"].view(np.uint64), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(columns["node"][a]), pa.array(columns["node"][b])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            # The last run may go on in the next batch.
            last = np.ones(len(rows), bool)
            for c in order:
                values = rows.column(c).to_numpy()
                last &= values == values[-1]
            first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if first:
                yield compare(rows.slice(0, first))
            rest = rows.slice(first)
        if rest is not None:
            yield compare(rest)

    return filed.mapInArrow(run, "u long, v long").where("u != v")


def simhash_groups(docs: DataFrame, words: int, max_bits: int) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable over links. One row per input row: repeated rows
    and null doc_ids are kept (a null is never a component_id while its component has another
    doc_id), other columns are ignored. A null, empty or blank text has the fingerprint zero and
    links like any other; a text of fewer than `words` words is one shingle.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints")
    classes = materialize(rows.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(near_links(classes.withColumn("fp", F.col("node")), max_bits))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted, "roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    return rows.join(named.select(F.col("node").alias("fp"), "component_id"), "fp").select("doc_id", "fp", "component_id")
