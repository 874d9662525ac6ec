"""Divergence of each source's vocabulary from the other sources of its language.

A first pass counts in how many documents of its language each term occurs, exactly, and keeps the
frequent ones. Kept terms are dealt to shards of one language; each shard gets a minimal perfect hash
(bit arrays of falling size, in which a term owns the first bit that no other term of its level has;
its slot is the number of bits before it) together with its terms in the order of their slots. The
hashes are broadcast in blocks of bounded size. The second pass looks the terms of a text up, compares
the stored term, and adds to an array of slots for each (language, source). Shares, distances and the
leading terms are then arithmetic on one array of sources by slots for each shard.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import SpanHash, documents, mix, rows_of, runs
from corpusflow.session import materialize

MIN_DOCUMENTS = 30
TOP_TERMS = 50
SMOOTHING = 5
UNIT = 1_000_000_000

# Terms of a shard, and of its array of sources by slots the numbers.
SHARD_TERMS, SHARD_CELLS = 1024, 1 << 20
# Bytes of perfect hashes and terms that are broadcast at once; each block is a pass over the texts.
BLOCK_BYTES = 32 << 20
# Slots that a task holds before it hands its counts on.
HELD_SLOTS = 8 << 20
LEVELS = 24
_TEXT_BYTES = 4 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INK = np.zeros(256, bool)
_INK[128:] = _INK[97:123] = True


def term_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms, and for each occurrence its row and its term's number."""
    folded = _FOLD[data]
    ink = _INK[folded]
    start, end = runs(ink, offsets)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - start)])
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(folded[ink])]
    coded = pa.Array.from_buffers(pa.large_string(), len(start), buffers).dictionary_encode()
    return coded.dictionary, rows_of(np.searchsorted(start, offsets)), coded.indices.to_numpy().astype(np.int64)


def _names(batch: pa.RecordBatch, name: str, first: int, last: int) -> tuple[list[str], np.ndarray]:
    """The distinct values of a text column in a range of rows, and each row's number of them."""
    coded = pc.fill_null(batch.column(name).slice(first, last - first), "").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n): in how many documents of the language the term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in documents(batch, _TEXT_BYTES):
                terms, row, code = term_codes(data, offsets)
                langs, lang = _names(batch, "lang", first, last)
                once = np.unique(row * max(len(terms), 1) + code)
                pair, n = np.unique(lang[once // max(len(terms), 1)] * max(len(terms), 1) + once % max(len(terms), 1), return_counts=True)
                if len(pair):
                    named = pa.array(langs, pa.string()).take(pa.array(pair // len(terms)))
                    yield pa.RecordBatch.from_arrays([named, terms.take(pa.array(pair % len(terms))).cast(pa.string()), pa.array(n)], names=["lang", "term", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def spans_of(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text array, end to end, and its bounds."""
    terms = terms.cast(pa.large_string())
    if not len(terms):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    return np.frombuffer(terms.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def hashes_of(terms: pa.Array) -> np.ndarray:
    data, bounds = spans_of(terms)
    return SpanHash(data)(bounds[:-1], bounds[1:])


def shard_of(hashes: np.ndarray, shards: np.ndarray | int) -> np.ndarray:
    return (mix(hashes + np.uint64(LEVELS)) % np.asarray(shards).astype(np.uint64)).astype(np.int64)


def _place(hashes: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return (mix(hashes + np.uint64(level)) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The bit words of each level, and the keys in the order of their slots. Keys that no level tells
    apart (equal hashes) come last, without a bit."""
    left, levels, order = np.arange(len(hashes)), [], []
    while len(left) and len(levels) < LEVELS:
        size = 64 * (2 * len(left) // 64 + 1)
        at = _place(hashes[left], len(levels), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        levels.append(np.packbits(bits, bitorder="little").view(np.uint64))
        order.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    return levels, np.concatenate([*order, left]).astype(np.int64)


class Block:
    """Perfect hashes of several shards, as arrays over all of them.

    plan: language to (first shard, number of shards); shards: (shard, levels, terms) in order.
    """

    def __init__(self, plan: dict[str, tuple[int, int]], shards: list[tuple[int, list[np.ndarray], list[str]]]):
        self.plan, self.low, self.high = plan, shards[0][0], shards[-1][0]
        count, depth = self.high - self.low + 1, max(len(levels) for _, levels, _ in shards)
        self.size = np.zeros((count, depth), np.int64)
        self.word = np.zeros((count, depth), np.int64)
        self.first = np.zeros(count + 1, np.int64)
        words, ranks, terms, at, rank = [], [], [], 0, 0
        self.loose: dict[tuple[int, str], int] = {}
        for shard, levels, names in shards:
            i, before = shard - self.low, rank
            for k, bits in enumerate(levels):
                self.size[i, k], self.word[i, k] = 64 * len(bits), at
                ones = np.bitwise_count(bits).astype(np.int64)
                words.append(bits)
                ranks.append(rank + np.cumsum(ones) - ones)
                at, rank = at + len(bits), rank + int(ones.sum())
            self.loose |= {(shard, names[k]): before + k for k in range(rank - before, len(names))}
            rank = before + len(names)
            self.first[i + 1] = rank
            terms += names
        self.bits, self.rank = np.concatenate(words), np.concatenate(ranks)
        self.data, self.bounds = spans_of(pa.array(terms, pa.large_string()))

    def slots(self, lang: str) -> tuple[int, int]:
        """The slots of a language in this block."""
        first, n = self.plan.get(lang, (0, 0))
        a, b = max(first, self.low) - self.low, min(first + n, self.high + 1) - self.low
        return (int(self.first[a]), int(self.first[b])) if a < b else (0, 0)

    def find(self, lang: str, terms: pa.Array) -> np.ndarray:
        """The slot of each term of a language; -1: not in this block."""
        first, n = self.plan[lang]
        hashes, (data, bounds) = hashes_of(terms), spans_of(terms)
        shard = first + shard_of(hashes, n) - self.low
        out = np.full(len(terms), -1, np.int64)
        left = np.flatnonzero((shard >= 0) & (shard <= self.high - self.low))
        for level in range(self.size.shape[1]):
            left = left[self.size[shard[left], level] > 0]
            if not len(left):
                break
            s = shard[left]
            at = _place(hashes[left], level, self.size[s, level])
            word, bit = self.word[s, level] + at // 64, (at % 64).astype(np.uint64)
            held = self.bits[word]
            there = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[there]] = (self.rank[word] + below)[there]
            left = left[~there]
        # A term that is none of the block's may have met another's bit: the stored term decides.
        met = np.flatnonzero(out >= 0)
        size = bounds[met + 1] - bounds[met]
        mine = self.bounds[out[met]]
        same = size == self.bounds[out[met] + 1] - mine
        some = met[same]
        out[met[~same]] = -1
        if len(some):
            size, mine = size[same], mine[same]
            ends = np.cumsum(size)
            step = np.arange(ends[-1]) - np.repeat(ends - size, size)
            equal = data[np.repeat(bounds[some], size) + step] == self.data[np.repeat(mine, size) + step]
            out[some[~np.logical_and.reduceat(equal, ends - size)]] = -1
        if self.loose:
            for i in np.flatnonzero(out < 0).tolist():
                out[i] = self.loose.get((int(shard[i]) + self.low, terms[i].as_py()), -1)
        return out


def group_counts(docs: DataFrame, block: Block) -> DataFrame:
    """(shard, source, slot, n): occurrences of the block's terms in each source of the shard's language, by task."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_BYTES at most

    def written(held: dict[tuple[str, str], np.ndarray], block: Block) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            some = np.flatnonzero(counts)
            if len(some):
                slot = some + block.slots(lang)[0]
                i = np.searchsorted(block.first, slot, "right") - 1
                columns = [(block.low + i).astype(np.int32), (slot - block.first[i]).astype(np.int32), counts[some]]
                shard, slot, n = map(pa.array, columns)
                yield pa.RecordBatch.from_arrays([shard, pa.array([source] * len(some), pa.string()), slot, n], names=["shard", "source", "slot", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = shared.value, {}, 0
        for batch in batches:
            for first, last, data, offsets in documents(batch, _TEXT_BYTES):
                terms, row, code = term_codes(data, offsets)
                langs, lang = _names(batch, "lang", first, last)
                sources, source = _names(batch, "source", first, last)
                for i, name in enumerate(langs):
                    low, high = block.slots(name)
                    mine = np.flatnonzero(lang[row] == i) if low < high else []
                    if not len(mine):
                        continue
                    pair, n = np.unique(source[row[mine]] * len(terms) + code[mine], return_counts=True)
                    used, which = np.unique(pair % len(terms), return_inverse=True)
                    slot = block.find(name, terms.take(pa.array(used)))[which]
                    pair, n, slot = pair[slot >= 0] // len(terms), n[slot >= 0], slot[slot >= 0]
                    for s in np.unique(pair).tolist():
                        key = (name, sources[s])
                        if key not in held:
                            held[key] = np.zeros(high - low, np.int64)
                            size += high - low
                        held[key][slot[pair == s] - low] += n[pair == s]
                    if size > HELD_SLOTS:
                        yield from written(held, block)
                        held, size = {}, 0
        yield from written(held, block)

    return docs.select("lang", "source", "text").mapInArrow(run, "shard int, source string, slot int, n long")


def share(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly: three digits of the
    quotient at a time, so that no product exceeds 64 bits."""
    rest, below = count + SMOOTHING, total + SMOOTHING * terms
    out = np.zeros_like(rest)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digits
    return out + 1


def compared(sources: list[str], totals: np.ndarray, terms: int, counts: np.ndarray) -> Iterator[tuple]:
    """(part, source, item, slot, value) of one shard; counts: sources by slots. A source's leading terms
    include all that may be among its first TOP_TERMS."""
    p, q = share(counts, totals[:, None], terms), share(counts.sum(0), totals.sum(), terms)
    for i, name in enumerate(sources):
        yield "pair", name, sources, None, np.abs(p - p[i]).sum(1)
        lead = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        value = (p[i] - q)[lead]
        if len(lead) > TOP_TERMS:
            least = np.partition(value, -TOP_TERMS)[-TOP_TERMS]
            lead, value = lead[value >= least], value[value >= least]
        yield "term", name, None, lead, value


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one shard after the other, from rows sorted by shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[0].column("shard")[0].as_py() != shard[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _compare_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_shard(batches):
        head = rows.filter(pc.is_valid(rows.column("total"))).sort_by("source")
        sources = head.column("source").combine_chunks()
        entries = rows.filter(pc.is_valid(rows.column("slot")))
        shard, slot = rows.column("shard")[0], entries.column("slot").to_numpy()
        counts = np.zeros((len(sources), int(slot.max()) + 1 if len(slot) else 0), np.int64)
        counts[pc.index_in(entries.column("source"), sources).to_numpy(), slot] = entries.column("n").to_numpy()
        size = head.column("size")[0].as_py()
        counts = np.pad(counts, ((0, 0), (0, size - counts.shape[1])))
        totals, terms = head.column("total").to_numpy(), head.column("terms")[0].as_py()
        for part, source, items, lead, value in compared(sources.to_pylist(), totals, terms, counts):
            n = len(value)
            columns = [pa.array([shard.as_py()] * n, pa.int32()), pa.array([part] * n, pa.string()), pa.array([source] * n, pa.string())]
            columns += [pa.array(items or [None] * n, pa.string()), pa.array([None] * n if lead is None else lead, pa.int32()), pa.array(value)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "part", "source", "item", "slot", "value"])


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shard = batch.column("first").to_numpy() + shard_of(hashes_of(batch.column("term")), batch.column("shards").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), batch.column("term")], names=["shard", "term"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_shard(batches):
        terms = rows.column("term").combine_chunks()
        levels, order = perfect_hash(hashes_of(terms))
        bits = pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary()))
        named = pa.array([terms.take(pa.array(order)).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([rows.column("shard").combine_chunks()[:1], bits, named], names=["shard", "levels", "terms"])


def perfect_hashes(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """(shard, levels, terms in slot order): built in tasks, one shard at a time.

    kept: (lang, term); langs: (lang, first, shards)."""
    dealt = kept.join(langs, "lang").select("term", "first", "shards").mapInArrow(_assign, "shard int, term string")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "term")
    return dealt.mapInArrow(_hashed, "shard int, levels array<binary>, terms array<string>")


def blocks(hashes: DataFrame, langs: DataFrame) -> Iterator[Block]:
    """The hashes a bounded number of bytes at a time, read from their table."""
    bits = F.aggregate("levels", F.lit(0), lambda a, x: a + 2 * F.length(x))
    names = F.aggregate("terms", F.lit(0), lambda a, x: a + F.octet_length(x) + 8)
    sizes = hashes.select("shard", (bits + names).alias("size")).orderBy("shard").collect()  # a row for thousands of terms
    at = 0
    while at < len(sizes):
        to, size = at + 1, sizes[at]["size"]
        while to < len(sizes) and size + sizes[to]["size"] <= BLOCK_BYTES:
            size, to = size + sizes[to]["size"], to + 1
        low, high = sizes[at]["shard"], sizes[to - 1]["shard"]
        plan = {r.lang: (r.first, r.shards) for r in langs.where(f"first <= {high} and first + shards > {low}").collect()}
        rows = hashes.where(F.col("shard").between(low, high)).orderBy("shard").collect()
        yield Block(plan, [(r.shard, [np.frombuffer(x, np.uint64) for x in r.levels], r.terms) for r in rows])
        at = to


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of `docs` (text, lang, source).

    part `pair`: the item is another source of the language, the value their distance over all kept
    terms. part `term`: the item is a kept term that the source uses more than its language does, the
    value by how much, for the first TOP_TERMS. Nulls are empty strings: an empty text has no
    terms, an empty lang or source is a name like others. A language without kept terms has
    distances of zero and no leading terms. Repeated rows are documents of their own, other columns are ignored, an empty table
    gives no rows.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = materialize(document_counts(docs).where(F.col("n") >= min_documents).drop("n"), "terms")
    groups = materialize(docs.select("lang", "source").distinct(), "sources")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms")).join(groups.groupBy("lang").agg(F.count("*").alias("sources")), "lang")
    most = F.least(F.lit(SHARD_TERMS), F.greatest(F.lit(1), F.expr(f"{SHARD_CELLS} div sources")))
    langs = langs.withColumn("shards", F.ceil(F.col("terms") / most).cast("int"))
    # Languages with kept terms only, each of which has thirty documents and more.
    before = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    langs = materialize(langs.withColumn("first", F.coalesce(F.sum("shards").over(before), F.lit(0)).cast("int")), "languages")
    hashes = materialize(perfect_hashes(kept, langs.select("lang", "first", "shards")), "hashes")
    counts = None
    for block in blocks(hashes, langs):
        part = group_counts(docs, block).groupBy("shard", "source", "slot").agg(F.sum("n").alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    without = groups.join(langs.select("lang"), "lang", "left_anti")
    zero = without.join(without.withColumnRenamed("source", "item"), "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
    columns = ["lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank")]
    if counts is None:
        return zero.select(*columns)
    counts = materialize(counts, "counts")
    shards = langs.select("lang", "terms", F.explode(F.sequence("first", F.col("first") + F.col("shards") - 1)).alias("shard"))
    totals = counts.groupBy("shard", "source").agg(F.sum("n").alias("n")).join(shards, "shard").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = groups.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    sized = shards.join(hashes.select("shard", F.size("terms").alias("size")), "shard")
    heads = totals.join(sized, "lang").select("shard", "source", "total", "terms", "size")
    both = heads.unionByName(counts, allowMissingColumns=True)
    both = both.repartition("shard").sortWithinPartitions("shard")
    result = both.mapInArrow(_compare_shards, "shard int, part string, source string, item string, slot int, value long")
    result = materialize(result.where("item is null or item != source").join(shards.select("shard", "lang"), "shard"), "compared")
    pairs = result.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    names = hashes.select("shard", F.posexplode("terms").alias("slot", "item"))
    terms = result.where("part = 'term'").drop("item").join(names, ["shard", "slot"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.unionByName(zero).select(*columns).unionByName(terms.where(F.col("rank") <= TOP_TERMS))
