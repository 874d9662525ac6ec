"""Chat formatting: masks against a plain reading, odd rows, long conversations."""

import hashlib

import numpy as np
import pytest

from corpusflow.llm import chat_format as chat

SCHEMA = "conv_id long, turn long, role string, text string, part int, ids string, n_turns string, loss int"
HARD = ["", " ", "\n\n", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "<", "|", "<\\", "é <|endoftext|> x", "<|im_start|>assistant<|im_sep|>ok", "  two  ", "😀", "á"]


def digest(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


@pytest.fixture(scope="module")
def encoder():
    return chat.ChatEncoder()


@pytest.mark.parametrize("text", HARD)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(s in chat.escape(text) for s in (chat.START, chat.SEP, chat.END))


def test_mask_holds_the_learned_texts_only(encoder):
    turns = [(role, text) for text in HARD for role in ("user", "assistant", "assistant", "<|im_sep|>")]
    formatted, spans = chat.render(turns)
    ids, offsets = encoder.encode(formatted)
    assert offsets[-1] == len(formatted.encode())
    mask = chat.loss_mask(offsets, spans)
    brute = [any(a < e and s < b for s, e in spans.tolist() if e > s) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert mask.tolist() == brute
    assert list(encoder.texts(ids, mask)) == [t for r, t in turns if r == "assistant" and t]
    assert chat.parse(formatted) == turns


def test_parts_have_the_ids_of_the_whole(encoder):
    turns = [("user", "one "), ("assistant", " two\n"), ("user", "\n three")]
    whole, _ = encoder.encode(chat.render(turns)[0])
    parts = [encoder.encode(chat.render([t])[0])[0] for t in turns]
    assert np.concatenate(parts).tolist() == whole.tolist()


@pytest.fixture(scope="module")
def talks():
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)]
    rows += [(2, None, "assistant", "first"), (2, 0, None, None), (2, 0, None, None), (2, 0, "assistant", "b"), (2, 0, "assistant", "a")]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "assistant", "la " * 400_000), (4, 5, "assistant", "")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"{i} " + "word " * 8000) for i in range(240)]  # 10 MB
    return rows


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        out[conv] = digest([(r[2] or "", r[3] or "") for r in mine])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "i", "n", 0) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("way", [chat.digests, lambda c: chat.read_back(chat.format_conversations(c))])
def test_read_back(spark, talks, way):
    got = {r[0]: tuple(r)[1:5] for r in way(frame(spark, talks)).collect()}
    assert got == expected(talks)


def test_long_conversations_have_several_parts(spark, talks):
    parts = chat.format_conversations(frame(spark, talks)).where("conv_id = 5").select("part", "formatted").orderBy("part").collect()
    assert len(parts) > chat.HELD and max(len(p.formatted) for p in parts) < 1.2 * chat.SEGMENT_BYTES
    turns = [t for p in parts for t in chat.parse(p.formatted)]
    assert turns == [(r[2], r[3]) for r in talks if r[0] == 5]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.digests(none).count() == 0 and chat.format_conversations(none).count() == 0
