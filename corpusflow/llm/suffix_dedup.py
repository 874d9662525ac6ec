"""Removal of repeated strings with suffix arrays.

Every byte covered by a string of LENGTH bytes that also starts earlier is removed. The work is
divided by content, so that equal strings meet without comparing all documents with each other:

1. Of copies of a whole text only the first takes part; the others are covered as a whole.
2. The anchor of a string is the smallest hash of its GRAM-byte parts. Equal strings have equal
   anchors, and neighbouring strings mostly share theirs, so a text falls into short contexts of
   one anchor each. Contexts whose anchor occurs once hold no repeated string and go no further.
3. Of equal contexts of an anchor the first stays, the others are covered. If an anchor has only
   one context, and that has its anchor once, nothing else can repeat.
4. The contexts left are cut from the texts and shuffled to shards by anchor. A shard sorts all its
   suffixes (Larsson and Sadakane: ranks of h bytes give ranks of 2h bytes, groups already sorted
   are left alone), finds the common prefixes of neighbours (Kasai), and so the groups of equal
   strings and the first of each group.
5. A frequent anchor is spread over several shards. Each passes on the first of each of its
   strings; sorted slices of these are merged by binary search.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import SpanHash, documents, mix, rows_of
from corpusflow.session import materialize

LENGTH = 100
GRAM = 16
# Strings of a context, bytes of a shard, rows resolved at once, contexts of an anchor in a shard.
RUN = 127
SHARD_BYTES = 3 << 18
ROWS = 1 << 16
HOT = 4096
# Stands for a null doc_id, which comes after all others.
NO_ID = (1 << 63) - 1


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


# A context's place in its text: start of its first string, whether its anchor is in it twice (then
# its own strings may repeat), number of its strings. Above these, twelve bits each of hashes of the
# anchor with the SIDE bytes before it, and with those after it; zero where the text has none. Equal
# strings around an anchor agree on one side or the other, if their contexts have the anchor once.
SIDE = (LENGTH - GRAM) // 2
_SIDE_BITS, _START_BITS, _RUN_BITS = 12, 31, 7


def placed(start: np.ndarray, twice: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (((left << _SIDE_BITS | right) << _START_BITS | start) << 1 | twice) << _RUN_BITS | n


def place_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First string's start and number of strings."""
    return place >> 1 + _RUN_BITS & (1 << _START_BITS) - 1, place & RUN


def sides_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    side = place >> 1 + _RUN_BITS + _START_BITS
    return side >> _SIDE_BITS, side & (1 << _SIDE_BITS) - 1


def shared_side(group: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Contexts that agree on a side with another of their group."""
    out = np.zeros(len(place), bool)
    for side in sides_of(place):
        _, which, count = np.unique(group << _SIDE_BITS | side, return_inverse=True, return_counts=True)
        out |= (count[which] > 1) & (side > 0)
    return out


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, anchor, hash of the bytes) of all contexts."""
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty
    spans = SpanHash(data)
    grams, width = spans.grams(GRAM), LENGTH - GRAM + 1
    anchor = sliding_min(grams, width)
    row = rows_of(offsets)
    inside = row[: len(anchor)] == row[LENGTH - 1 :]
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (row[1 : len(anchor)] != row[: len(anchor) - 1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(anchor))
    # The strings of a run end where no string of that row follows.
    count = np.concatenate([[0], np.cumsum(inside)])
    size = count[stop] - count[start]
    parts = -(-size // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(start, parts) + nth * RUN
    n = np.minimum(RUN, np.repeat(size, parts) - nth * RUN)
    # Where the anchors are: at parts that are the smallest of some string around them.
    edge = np.zeros(width - 1, np.uint64)
    above = ~sliding_min(~np.concatenate([edge, anchor, edge])[: len(grams) + width - 1], width)
    at = np.flatnonzero(grams == above)
    low, high = np.searchsorted(at, first), np.searchsorted(at, first + n + width - 1)
    which = np.repeat(np.arange(len(first)), high - low)
    there = np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange(len(which))
    here = grams[at[there]] == anchor[first[which]]
    which, there = which[here], at[there[here]]
    twice = np.bincount(which, minlength=len(first)) > 1
    its = there[np.searchsorted(which, np.arange(len(first)))]
    low, high = offsets[row[first]], offsets[row[first] + 1]

    def side(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        there = (begin >= low) & (end <= high)
        hashes = spans(np.where(there, begin, low), np.where(there, end, low)) % np.uint64((1 << _SIDE_BITS) - 1)
        return np.where(there, hashes.astype(np.int64) + 1, 0)

    place = placed(first - low, twice, n, side(its - SIDE, its + GRAM), side(its, its + GRAM + SIDE))
    return row[first], place, anchor[first].view(np.int64), spans(first, first + n + LENGTH - 1).view(np.int64)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(data), np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : len(data) + i]
    return word


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order, a suffix before those it begins. Below 2**21 bytes a pair of
    ranks and a start are one number, and numbers are sorted many times as fast as places by keys."""
    n = len(data)
    width = max(n, 2).bit_length()
    # As many letters at first as fit beside the start, in a dense alphabet; zero is the end.
    known, letter = np.unique(data, return_inverse=True)
    bits = len(known).bit_length()
    h = max(1, (63 - width) // bits)
    padded = np.concatenate([letter + 1, np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(h):
        key = key << bits | padded[i : n + i]
    rank, order = np.empty(n + 1, np.int64), np.empty(n, np.int64)
    rank[n] = 0

    def settle(at: np.ndarray, key: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Sort the places `at` by key; give their suffixes new ranks; the places still open."""
        if 3 * width < 64:
            packed = np.sort(key << width | suffix)
            suffix, key = packed & (1 << width) - 1, packed >> width
        else:
            by_key = np.argsort(key)
            suffix, key = suffix[by_key], key[by_key]
        order[at] = suffix
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        rank[suffix] = np.repeat(at[first], size) + 1
        return at[np.repeat(size > 1, size)]

    open_ = settle(np.arange(n), key, np.arange(n))
    while len(open_):
        suffix = order[open_]
        open_ = settle(open_, rank[suffix] << width | rank[np.minimum(suffix + h, n)], suffix)
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in `order`, up to `most`, by Kasai's rule: in
    text order it shrinks by one at most. Lanes of neighbouring positions advance together."""
    n = len(data)
    word = np.concatenate([words_at(data), np.zeros(most + 8, np.uint64)])
    before = np.full(n, n, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    steps = 64
    lanes = np.arange(0, n, steps)
    h = np.zeros(len(lanes), np.int64)
    for t in range(steps):
        lane = np.flatnonzero(lanes + t < n)
        i = lanes[lane] + t
        j = before[i]
        k = np.maximum(h[lane] - 1, 0)
        k[j == n] = 0
        active = np.flatnonzero(j < n)
        while len(active):
            differ = word[np.minimum(i[active] + k[active], n)] ^ word[np.minimum(j[active] + k[active], n)]
            # Equal leading bytes from the exponent of the highest bit; the bit below it is cleared, so
            # that the conversion doesn't round up.
            top = (differ & ~(differ >> np.uint64(1))).astype(np.float64)
            same = np.where(differ == 0, 8, 7 - ((top.view(np.int64) >> 52) - 1023 >> 3))
            k[active] += same
            active = active[(same == 8) & (k[active] < most)]
        h[lane] = out[i] = np.minimum(k, most)
    return out[order]


def first_of_equal(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each of `starts` (ascending) the first whose LENGTH bytes are the same."""
    order = suffix_array(data)
    group = np.cumsum(common_prefixes(data, order, LENGTH) < LENGTH)
    of = np.empty(len(data), np.int64)
    of[order] = group
    _, first, which = np.unique(of[starts], return_index=True, return_inverse=True)
    return first[which]


def merged(first: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the same owner that overlap or touch, as one. Spans are in order of owner and start."""
    if not len(first):
        return first, end, owner
    new = np.append(True, (owner[1:] != owner[:-1]) | (first[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return first[at], np.append(end[at[1:] - 1], end[-1]), owner[at]


def resolve(rows: pa.Table, hot: int) -> pa.RecordBatch:
    """Contexts of repeated anchors: places that are covered (route null), and the first of each context
    that must be looked into (route: where to; odd if the anchor is spread).

    An anchor of which these rows are not all, or that is too frequent, isn't decided here: its
    contexts go on, fewer by the copies seen.
    """
    anchor, context, k, h, place, total = (rows.column(c).to_numpy() for c in ("anchor", "context", "k", "h", "place", "n"))
    order = np.lexsort((place_of(place)[0], h, k, context, anchor))
    anchor, context, k, h, place, total = (x[order] for x in (anchor, context, k, h, place, total))
    twice = place >> _RUN_BITS & 1
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    new = new_anchor | np.append(True, context[1:] != context[:-1])
    # A repeated row gives its contexts again.
    again = np.append(False, (k[1:] == k[:-1]) & (h[1:] == h[:-1]) & (place[1:] == place[:-1])) & ~new
    group = np.cumsum(new_anchor) - 1
    whole = np.bincount(group, 1 + twice) == total[new_anchor]
    settled = whole & (np.bincount(group, new) == 1) & (np.bincount(group, twice) == 0)
    covered = ~new & ~again
    # Of an anchor whose rows are all here, contexts that agree with no other on a side end here. Sides are
    # those of a context's first anchor, so if any context has the anchor twice, all go on.
    on = np.flatnonzero(new & ~settled[group])
    single = np.bincount(group, twice) == 0
    alone = (whole & single)[group[on]] & (total[on] <= hot) & ~shared_side(group[on], place[on])
    on = on[~alone]
    parts = -(-total[on] // hot)
    salt = (mix((k[on] ^ h[on] ^ place[on]).view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
    route = np.where(parts > 1, mix((anchor[on] + salt).view(np.uint64)).view(np.int64), anchor[on]) & ~1 | (parts > 1)
    pick = np.concatenate([np.flatnonzero(covered), on])
    n = int(covered.sum())
    routes = pa.array(np.concatenate([np.zeros(n, np.int64), route]), mask=np.arange(len(pick)) < n)
    return pa.RecordBatch.from_arrays([pa.array(k[pick]), pa.array(h[pick]), pa.array(place[pick]), routes], names=["k", "h", "place", "route"])


SPANS = "k long, h long, start long, stop long, string binary"


def _spans(k, h, start, stop, string=None) -> pa.RecordBatch:
    string = pa.array([None] * len(k), pa.binary()) if string is None else string
    return pa.RecordBatch.from_arrays([*map(pa.array, (k, h, start, stop)), string], names=["k", "h", "start", "stop", "string"])


def shard_spans(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Covered spans in the contexts of one shard; and, with `string`, the first of every string of a
    spread anchor."""
    rows = rows.combine_chunks()
    k, h, place, spread = (rows.column(c).to_numpy() for c in ("k", "h", "place", "route"))
    order = np.lexsort((place_of(place)[0], h, k))
    new = np.ones(len(order), bool)  # a repeated row gives its contexts again
    new[1:] = (k[order][1:] != k[order][:-1]) | (h[order][1:] != h[order][:-1]) | (place[order][1:] != place[order][:-1])
    order = order[new]
    k, h, place, spread = k[order], h[order], place[order], spread[order] & 1 == 1
    data = np.frombuffer(b"".join(rows.column("context").take(pa.array(order)).to_pylist()), np.uint8)
    begins, n = place_of(place)
    begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = begin[owner] + within
    place = begins[owner] + within
    first = first_of_equal(data, starts)
    own = np.arange(len(starts))
    later = np.flatnonzero(first != own)
    a, b, by = merged(place[later], place[later] + LENGTH, owner[later])
    yield _spans(k[by], h[by], a, b)
    pass_on = np.flatnonzero((first == own) & spread[owner])
    for at in range(0, len(pass_on), 10_000):
        some = pass_on[at : at + 10_000]
        whole = data.tobytes()
        strings = pa.array([whole[s : s + LENGTH] for s in starts[some].tolist()], pa.binary())
        yield _spans(k[owner[some]], h[owner[some]], place[some], place[some] + LENGTH, strings)


def merge_strings(strings: np.ndarray, k: np.ndarray, h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of the strings also occur earlier. Sorted slices of the strings take part one after the
    other; each is looked up in what the slices before it have, by binary search."""
    later = np.zeros(len(strings), bool)
    have, owner = strings[:0], np.zeros(0, np.int64)
    for at in range(0, len(strings), HOT):
        slice_ = np.arange(at, min(at + HOT, len(strings)))
        slice_ = slice_[np.lexsort((start[slice_], h[slice_], k[slice_], strings[slice_]))]
        fresh = np.append(True, strings[slice_][1:] != strings[slice_][:-1])
        later[slice_[~fresh]] = True
        slice_ = slice_[fresh]
        place = np.searchsorted(have, strings[slice_])
        known = np.flatnonzero(place < len(have))
        known = known[have[place[known]] == strings[slice_[known]]]
        for i in known.tolist():
            a, b = owner[place[i]], slice_[i]
            first, second = (a, b) if (k[a], h[a], start[a]) < (k[b], h[b], start[b]) else (b, a)
            later[second], owner[place[i]] = True, first
        unknown = np.setdiff1d(np.arange(len(slice_)), known)
        have = np.insert(have, place[unknown], strings[slice_[unknown]])
        owner = np.insert(owner, place[unknown], slice_[unknown])
    return later


def _tables(batches: Iterator[pa.RecordBatch], column: str, most: int, most_of_one: int | None = None) -> Iterator[pa.Table]:
    """Sorted rows as tables of about `most` rows that end where `column` changes; a value's rows are
    divided only from `most_of_one` rows on."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if len(held) < most:
            continue
        values = held.column(column).to_numpy()
        changes = np.flatnonzero(values[1:] != values[:-1]) + 1
        at = 0
        while len(held) - at >= most:
            cut = changes[(changes > at) & (changes <= at + most)]
            later = changes[changes > at]
            if len(cut) or len(later):
                end = int(cut[-1] if len(cut) else later[0])
            elif most_of_one and len(held) - at >= most_of_one:
                end = at + most_of_one
            else:
                break
            yield held.slice(at, end - at)
            at = end
        held = held.slice(at)
    if held is not None and len(held):
        yield held


def _find_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, data, offsets in documents(batch):
            row, place, anchor, context = contexts(data, offsets)
            at = pa.array(first + row)
            columns = [pa.array(anchor), pa.array(context), batch.column("k").take(at), batch.column("h").take(at), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "context", "k", "h", "place"])


def _resolve(hot: int, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tables(batches, "anchor", at_once, 4 * at_once):
            yield resolve(rows, hot)

    return run


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, data, offsets in documents(batch):
            whole = data.tobytes()
            for r in range(len(offsets) - 1):
                wanted = batch.column("wanted").slice(first + r, 1).flatten()
                if not len(wanted):
                    continue
                place = wanted.field("place").to_numpy()
                start, n = place_of(place)
                start = start + offsets[r]
                cut = [whole[x:y] for x, y in zip(start.tolist(), (start + n + LENGTH - 1).tolist(), strict=True)]
                ids = [pa.array(np.full(len(cut), batch.column(c)[first + r].as_py())) for c in ("k", "h")]
                columns = [wanted.field("route"), *ids, pa.array(place), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["route", "k", "h", "place", "context"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _tables(batches, "route", SHARD_BYTES // (LENGTH + RUN)):
        yield from shard_spans(rows)


def _merges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans as they come, and those of strings that occur in several shards."""

    known = []
    for batch in batches:
        yield batch.filter(batch.column("string").is_null())
        known.append(batch.filter(batch.column("string").is_valid()))
    for rows in _tables(iter(known), "string", ROWS):
        text = np.array(rows.column("string").to_pylist(), f"S{LENGTH}")
        k, h, start, stop = (rows.column(c).to_numpy() for c in ("k", "h", "start", "stop"))
        later = merge_strings(text, k, h, start)
        yield _spans(k[later], h[later], start[later], stop[later])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        copy = batch.column("copy").to_numpy(zero_copy_only=False)
        for first, _, data, offsets in documents(batch):
            whole, rows = data.tobytes(), []
            for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                text, spans = whole[a:b], []
                if copy[first + r]:
                    spans = [(0, b - a)] if b - a >= LENGTH else []
                else:
                    found = batch.column("spans").slice(first + r, 1).flatten()
                    x, y = (found.field(c).to_numpy() for c in ("start", "stop"))
                    start, n = place_of(batch.column("covered").slice(first + r, 1).flatten().to_numpy())
                    x, y = np.concatenate([x, start]), np.concatenate([y, start + n + LENGTH - 1])
                    order = np.lexsort((y, x))
                    x, y = x[order], np.maximum.accumulate(y[order])
                    x, y, _ = merged(x, y, np.zeros(len(x)))
                    spans = list(zip(x.tolist(), y.tolist(), strict=True))
                ends = [0, *(y for _, y in spans)]
                kept = b"".join(text[e:s] for e, s in zip(ends, [*(x for x, _ in spans), len(text)], strict=True))
                rows.append((b - a, b - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            columns = [batch.column("k").slice(first, len(rows)), *(pa.array([x[i] for x in rows]) for i in range(4))]
            columns.append(pa.array([x[4] for x in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def drop_repeats(docs: DataFrame, hot: int = HOT, at_once: int = ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of `docs` (doc_id, text).

    kept: the bytes that are left. Documents come in the order of doc_id, those of the same doc_id
    in the order of a hash of their texts, those without one last. Rows that repeat both doc_id and
    text are one document and each give its result. A null text is empty; texts of fewer than LENGTH
    bytes stay whole. Other columns are ignored. doc_id is an integer. An anchor of over `hot` contexts
    is spread; `at_once` rows are resolved at once. Neither changes the result.
    """
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k")
    text = F.coalesce("text", F.lit("")).alias("text")
    whole = docs.select(k, F.xxhash64(text).alias("h"), text)
    # The first document of each text; text and hash only, so that the text isn't shuffled here.
    reps = materialize(whole.groupBy("h", F.octet_length("text")).agg(F.min("k").alias("k")).select("k", "h"), "texts")

    # One plan, in which every use of the texts is partitioned by (k, h): they are shuffled once.
    firsts = whole.join(reps, ["k", "h"], "left_semi")
    found = firsts.mapInArrow(_find_contexts, "anchor long, context long, k long, h long, place long")
    times = F.lit(1) + F.shiftright("place", _RUN_BITS).bitwiseAND(1)
    counts = found.groupBy("anchor").agg(F.sum(times).alias("n")).where("n > 1")
    repeated = found.join(counts, "anchor").sortWithinPartitions("anchor")
    resolved = repeated.mapInArrow(_resolve(hot, at_once), "k long, h long, place long, route long")
    lists = resolved.groupBy("k", "h").agg(
        F.collect_list(F.when(F.col("route").isNull(), F.col("place"))).alias("covered"),
        F.collect_list(F.when(F.col("route").isNotNull(), F.struct("route", "place"))).alias("wanted"),
    )
    cut = whole.join(lists, ["k", "h"]).select("k", "h", "text", "wanted")
    cut = cut.mapInArrow(_cut_contexts, "route long, k long, h long, place long, context binary")
    spans = cut.repartition("route").sortWithinPartitions("route").mapInArrow(_shards, SPANS)
    # Equal strings meet; other spans go anywhere.
    spans = spans.withColumn("to", F.when(F.col("string").isNull(), F.xxhash64("k", "h", "start")).otherwise(F.xxhash64("string")))
    spans = spans.repartition("to").drop("to").sortWithinPartitions("string").mapInArrow(_merges, SPANS)
    spans = spans.groupBy("k", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    marked = whole.join(reps.distinct().withColumn("rep", F.lit(True)), ["k", "h"], "left")
    marked = marked.join(lists.drop("wanted"), ["k", "h"], "left").join(spans, ["k", "h"], "left")
    marked = marked.select("k", "text", F.col("rep").isNull().alias("copy"), "covered", "spans")
    out = marked.mapInArrow(_remove, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    doc_id = F.when(F.col("k") != NO_ID, F.col("k")).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id")
    return out.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
