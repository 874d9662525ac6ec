"""Chat formatting with offset-aligned loss masks.

Conversations are rendered whole by a template of three control strings around role and text. The
rendered string is encoded once; the bytes of its tokens give each token's offsets, and the sorted
spans of the assistant's texts are intersected with the sorted token spans by binary search. Control
strings are tokens of their own, before the words are split, so no token crosses the border of a text
and the mask holds each assistant text exactly.

Rows are sorted by ranges of (conversation, turn), so a conversation of any length is dealt over many
tasks; at a range's border, and every SEGMENT_BYTES, a rendered string ends with a turn. As control
strings bound every turn, the ids of the parts are those of the whole.
"""

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

VOCABULARY = "byte_bpe_50k"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
# A rendered string ends with the turn that brings it to this size.
SEGMENT_BYTES = 1 << 20
# Rendered strings of one conversation that a task holds to digest them itself.
HELD = 8
_ORDER_PREFIX = 64

_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile("(.*?)".join(map(re.escape, (START, SEP, END))), re.DOTALL)


def escape(text: str) -> str:
    """One more backslash in every `<`, any backslashes, `|`: no control string is left, none is lost."""
    return _OPEN.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The rendered turns, and (start, end) in bytes of the texts to learn, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        start = at + len(head.encode())
        end = start + len(body.encode())
        if role == LEARNED_ROLE:
            spans.append((start, end))
        out += [head, body, END]
        at = end + len(END)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered string."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class ChatEncoder:
    """Ids of rendered strings under a public vocabulary and, after its ids, the control strings."""

    def __init__(self, folder: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        path = f"{folder}/{VOCABULARY}.tiktoken" if folder else public_tokenizers.path(f"{VOCABULARY}.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        first = max(ranks.values()) + 2  # the id between is the vocabulary's own end of text
        self.controls = {s: first + i for i, s in enumerate((START, SEP, END))}
        self._encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.controls)
        self.token = [b""] * (first + 3)
        for token, rank in [*ranks.items(), *((s.encode(), i) for s, i in self.controls.items())]:
            self.token[rank] = token
        self._size = np.array([len(t) for t in self.token], np.int64)

    def encode(self, formatted: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids, and the byte offsets at which tokens start, the total size last."""
        ids = self._encoding.encode_to_numpy(formatted, allowed_special="all").astype(np.int32)
        return ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(self._size[ids])])

    def texts(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[str]:
        """The text of each run of tokens under the mask."""
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        for a, b in edges.reshape(-1, 2).tolist():
            yield unescape(b"".join([self.token[i] for i in ids[a:b].tolist()]).decode())


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens have a byte in one of the spans; both are sorted."""
    first = np.searchsorted(offsets[1:], spans[:, 0], "right")
    last = np.searchsorted(offsets[:-1], spans[:, 1], "left")
    steps = np.zeros(len(offsets), np.int64)
    filled = spans[:, 1] > spans[:, 0]
    np.add.at(steps, first[filled], 1)
    np.add.at(steps, last[filled], -1)
    return np.cumsum(steps)[:-1] > 0


class Segment(NamedTuple):
    formatted: str
    ids: np.ndarray
    loss: np.ndarray


class Digest:
    """What a conversation's segments say, read from them in order."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, segment: Segment, encoder: ChatEncoder) -> None:
        for role, text in parse(segment.formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for text in encoder.texts(segment.ids, segment.loss):
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars += len(segment.formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


DIGEST = pa.schema(
    [
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
SEGMENT = pa.schema([("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])
_DIGEST_DDL = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SEGMENT_DDL = "formatted string, ids array<int>, loss array<boolean>"
_AT_ONCE_ROWS, _AT_ONCE_BYTES = 2000, 4 << 20


class _Rows:
    """Rows to write, as record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= _AT_ONCE_ROWS or self.size >= _AT_ONCE_BYTES:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.rows, self.size = [], 0


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text) sorted by conversation and turn, in tasks that follow each other."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    rows = conversations.select("conv_id", "turn", filled("role"), filled("text"))
    # Short keys divide the ranges, as they are sampled; texts decide the order within them.
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, _ORDER_PREFIX))
    return ranged.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _segments(batches: Iterator[pa.RecordBatch], encoder: ChatEncoder) -> Iterator[tuple[object, bool, Segment]]:
    """(conversation, is it the first segment of it in this task, segment) of sorted rows."""

    def made() -> Segment:
        formatted, spans = render(turns)
        ids, offsets = encoder.encode(formatted)
        return Segment(formatted, ids, loss_mask(offsets, spans))

    current, turns, size, opens = None, [], 0, True
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if turns and (conv != current or size >= SEGMENT_BYTES):
                yield current, opens, made()
                opens, turns, size = conv != current, [], 0
            current = conv
            turns.append((role, text))
            size += len(role) + len(text)
    if turns:
        yield current, opens, made()


def format_conversations(conversations: DataFrame, folder: str | None = None) -> DataFrame:
    """(conv_id, part, formatted, ids, loss) of `conversations` (conv_id, turn, role, text).

    formatted: the rendered turns; ids: its tokens; loss: for each token whether it is to be learned. A
    conversation above SEGMENT_BYTES, or at the border of two tasks, has several parts, which follow
    each other by `part` (the numbers have gaps). Null role or text is empty; null turns come first; rows of one turn are
    ordered by role and text, repeated rows are turns of their own; rows without conv_id are one
    conversation of null. Other columns are ignored, an empty table gives no rows. `folder` holds the vocabulary.
    """
    kind = dict(conversations.dtypes)["conv_id"]

    schema = pa.schema([pa.field("conv_id", _arrow_type(conversations)), pa.field("part", pa.int64()), *SEGMENT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first, out = ChatEncoder(folder), TaskContext.get().partitionId() << 32, _Rows(schema)
        for n, (conv, _, segment) in enumerate(_segments(batches, encoder)):
            yield from out.add((conv, first + n, *segment), len(segment.formatted))
        yield from out.end()

    return in_order(conversations).mapInArrow(run, f"conv_id {kind}, part long, {_SEGMENT_DDL}")


def _arrow_type(rows: DataFrame) -> pa.DataType:
    return to_arrow_type(rows.schema["conv_id"].dataType)


def read_back(parts: DataFrame, folder: str | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted
    conversations (conv_id, part, formatted, ids, loss): turns come from `formatted`, the learned text from
    the ids under the mask. A task streams the parts of a conversation in order.

    Rows that have `n_turns` already are passed on (see `digests`)."""
    kind, conv_type = dict(parts.dtypes)["conv_id"], _arrow_type(parts)
    names = ["conv_id", *DIGEST.names]
    if "n_turns" not in parts.columns:
        parts = parts.select("conv_id", "part", *SEGMENT.names, *(F.lit(None).cast(t).alias(c) for c, t in map(str.split, _DIGEST_DDL.split(", "))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, current, digest = None, None, None
        out = _Rows(pa.schema([pa.field("conv_id", conv_type), *DIGEST]))
        for batch in batches:
            done = batch.column("n_turns").is_valid()
            ready = batch.filter(done)
            if len(ready):
                yield ready.select(names)
            for row in batch.filter(pc.invert(done)).to_pylist():
                encoder = encoder or ChatEncoder(folder)
                if digest is not None and row["conv_id"] != current:
                    yield from out.add((current, *digest.row()))
                    digest = None
                digest, current = digest or Digest(), row["conv_id"]
                digest.add(Segment(row["formatted"], np.array(row["ids"], np.int32), np.array(row["loss"], bool)), encoder)
        if digest is not None:
            yield from out.add((current, *digest.row()))
        yield from out.end()

    parts = parts.select("conv_id", "part", *SEGMENT.names, *DIGEST.names)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, f"conv_id {kind}, {_DIGEST_DDL}")


def digests(conversations: DataFrame, folder: str | None = None) -> DataFrame:
    """What `read_back` gives for `format_conversations`, in one pass: a task digests what it formats
    if the whole conversation is within the task, else hands the formatted parts on. So only
    conversations at the border of tasks, or of more than HELD parts, are shuffled again.
    """
    kind, conv_type = dict(conversations.dtypes)["conv_id"], _arrow_type(conversations)
    schema = pa.schema([pa.field("conv_id", conv_type), pa.field("part", pa.int64()), *SEGMENT, *DIGEST])
    no_digest, no_segment = (None,) * len(DIGEST), (None,) * len(SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, out = ChatEncoder(folder), TaskContext.get().partitionId() << 32, _Rows(schema)
        current, held, hand_on = None, [], True
        for conv, opens, segment in _segments(batches, encoder):
            if opens and part & 0xFFFFFFFF:
                if held and not hand_on:
                    digest = Digest()
                    for s in held:
                        digest.add(s, encoder)
                    yield from out.add((current, part, *no_segment, *digest.row()))
                    held = []
                for n, s in enumerate(held):
                    yield from out.add((current, part - len(held) + n, *s, *no_digest), len(s.formatted))
                held, hand_on = [], False
            current, part = conv, part + 1
            held.append(segment)
            if len(held) > HELD:
                hand_on = True
            if hand_on:
                for n, s in enumerate(held):
                    yield from out.add((current, part - len(held) + n, *s, *no_digest), len(s.formatted))
                held = []
        for n, s in enumerate(held):
            yield from out.add((current, part - len(held) + n, *s, *no_digest), len(s.formatted))
        yield from out.end()

    both = in_order(conversations).mapInArrow(run, f"conv_id {kind}, part long, {_SEGMENT_DDL}, {_DIGEST_DDL}")
    return read_back(both, folder)
