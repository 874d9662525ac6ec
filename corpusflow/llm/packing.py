"""Best-two-fit packing of tokenized documents into sequences.

A bin is filled greedily with the largest pieces that fit; then its smallest piece is replaced by
two unpacked pieces if these fill the expanded gap more tightly. Pieces of the same length are
interchangeable, so the plan is made over the histogram of lengths, at most `size` numbers whatever
the number of documents: a filling is repeated as often as its lengths last. Each piece then finds
its sequence by arithmetic from its rank among the pieces of its length.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import documents
from corpusflow.session import materialize

SIZE = 2048
VOCABULARY = "byte_bpe_50k"
END_ID = 0
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids of texts, as the tokenizers library gives them for VOCABULARY's .json file.

    The same vocabulary as ranks gives the same ids in a tenth of the time; texts that hold the
    special token's string are left to the first library, which alone knows it.
    """

    def __init__(self, folder: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        path = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
        with open(path(f"{VOCABULARY}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._json, self._slow = path(f"{VOCABULARY}.json"), None

    def __call__(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self._fast.encode_ordinary(text)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._json)
        return self._slow.encode(text, add_special_tokens=False).ids


def tokenized(docs: DataFrame, size: int, folder: str | None = None) -> DataFrame:
    """Pieces of all documents, with the task that made them and the rank of the piece among those
    of its length in that task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = Encoder(folder), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            for first, _, data, offsets in documents(batch):
                whole, rows = data.tobytes(), []
                for r, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    ids = np.array([*encode(whole[a:b].decode("utf-8", "replace")), END_ID], "<u4")
                    start, end = 0, len(ids) % size or size
                    piece = 0
                    while start < len(ids):
                        part = ids[start:end]
                        rows.append((first + r, piece, start, len(part), zlib.crc32(part.tobytes()), seen[len(part)]))
                        seen[len(part)] += 1
                        piece, start, end = piece + 1, end, end + size
                columns = [batch.column("doc_id").take(pa.array([x[0] for x in rows], pa.int64()))]
                columns += [pa.array([x[i] for x in rows], pa.int32() if i == 1 else pa.int64()) for i in range(1, 6)]
                columns.append(pa.array([task] * len(rows), pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "task_rank", "task"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task_rank long, task int"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fill(count: np.ndarray, size: int) -> list[tuple[int, int]]:
    """One bin as (length, how many), by best-two-fit. count[n]: unpacked pieces of length n."""
    left = count.copy()
    taken: dict[int, int] = {}
    gap = size
    while gap:
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits):
            break
        n = int(fits[-1])
        many = min(int(left[n]), gap // n)
        taken[n], gap = many, gap - many * n
        left[n] -= many
    if gap and sum(taken.values()) > 1:
        small = min(taken)
        room = gap + small
        pair = best_pair(left, room)
        if sum(pair) > small:
            taken[small] -= 1
            for n in pair:
                taken[n] = taken.get(n, 0) + 1
    return [(n, many) for n, many in taken.items() if many]


def best_pair(left: np.ndarray, room: int) -> tuple[int, int]:
    """Two unpacked lengths with the largest sum of at most `room`; (0, 0) if there are none."""
    have = np.flatnonzero(left[: room + 1])
    if not len(have):
        return 0, 0
    most = np.minimum(room - have, have - (left[have] < 2))  # a length once there pairs with smaller ones
    place = np.searchsorted(have, most, "right") - 1
    total = np.where((place >= 0) & (most > 0), have + have[np.maximum(place, 0)], 0)
    i = int(total.argmax())
    return (int(have[i]), int(have[place[i]])) if total[i] else (0, 0)


def plan(count: np.ndarray, size: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, uses in a sequence, offset in a sequence): pieces of
    `length` from that rank on fill these sequences, until the next row of that length."""
    count, used, sequence, rows = count.copy(), np.zeros_like(count), 0, []
    while count.any():
        taken = fill(count, size)
        times = min(int(count[n]) // many for n, many in taken)
        offset = 0
        for n, many in taken:
            rows.append((n, used[n], sequence, many, offset))
            used[n] += many * times
            count[n] -= many * times
            offset += many * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(length: np.ndarray, rank: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    big = np.int64(1) << 50
    at = np.searchsorted(rows[:, 0] * big + rows[:, 1], length * big + rank, "right") - 1
    _, first, sequence, many, offset = rows[at].T
    return sequence + (rank - first) // many, offset + (rank - first) % many * length


def pack(docs: DataFrame, size: int = SIZE, folder: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A document is its ids and END_ID; one longer than `size` is cut into pieces of `size`, the
    first being the remainder. Null and empty texts are documents of END_ID alone; rows that repeat
    a doc_id are packed each for itself, null doc_ids are carried along, other columns are ignored.
    """
    pieces = materialize(tokenized(docs, size, folder), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row.length] = row.n
    rows = docs.sparkSession.sparkContext.broadcast(plan(histogram, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["length", "task"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("first").to_numpy() + batch.column("task_rank").to_numpy()
            sequence, offset = place(batch.column("length").to_numpy(), rank, rows.value)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*columns, "first", "task_rank").mapInArrow(run, schema)
