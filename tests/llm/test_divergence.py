"""Source divergence against a plain reading of its definition; perfect hashes; exact shares."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import divergence as div

SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, value int, shard string, rank int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
RNG = random.Random(11)


def brute(rows, least):
    rows = [(*("" if x is None else x for x in r),) for r in rows]
    terms = [TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for t, _, _ in rows]
    df = Counter((lang, w) for (_, lang, _), t in zip(rows, terms, strict=True) for w in set(t))
    kept = defaultdict(set)
    for (lang, w), n in df.items():
        if n >= least:
            kept[lang].add(w)
    counts = {(lang, source): Counter() for _, lang, source in rows}
    for (_, lang, source), t in zip(rows, terms, strict=True):
        counts[lang, source].update(w for w in t if w in kept[lang])

    def shares(c, lang):
        n, v = sum(c.values()), len(kept[lang])
        return {w: 1 + (10**9 * (c[w] + 5)) // (n + 5 * v) for w in kept[lang]}

    out = []
    for (lang, source), c in counts.items():
        p = shares(c, lang)
        q = shares(sum((x for (g, _), x in counts.items() if g == lang), Counter()), lang)
        pairs = []
        for (other_lang, item), x in counts.items():
            if other_lang == lang and item != source:
                theirs = shares(x, lang)
                pairs.append((sum(abs(p[w] - theirs[w]) for w in p), item))
        lead = [(p[w] - q[w], w) for w in p if c[w] > 0 and p[w] > q[w]]
        for part, found in (("pair", pairs), ("term", lead)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, r) for r, (value, item) in enumerate(ordered, 1) if part == "pair" or r <= 50]
    return sorted(out)


def text(n, words):
    return " ".join(RNG.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    common = ["of", "The", "ÉTÉ", "été", "x1y", "don't", "a_b", "naïve", "日本"]
    words = {s: common + [f"{s}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] for s in "pqr"}
    out = [(text(RNG.randint(0, 60), words[s]), lang, s) for lang in ("en", "fr", None) for s in "pqr" for _ in range(40)]
    out += [("Rare words only", "de", "p"), (None, "de", "q"), ("", "de", None), ("alone", "it", "p"), (None, None, None)]
    out += [("Hot hot " * 30, "en", "p")] * 400 + [("z" * 3000 + " " + text(20_000, words["p"]), "en", "p")]
    return out


def run(spark, rows, **options):
    data = [(i, *r, 1, "t", 2, "s", 3) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    out = div.source_divergence(docs, **options)
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("least", [30, 1, 10_000])
def test_against_brute_force(spark, rows, least):
    assert run(spark, rows, min_documents=least) == brute(rows, least)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_many_shards_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(div, "SHARD_TERMS", 10)
    monkeypatch.setattr(div, "BLOCK_BYTES", 1000)
    some = rows[:240]
    assert run(spark, some, min_documents=5) == brute(some, 5)


def block(names, equal=()):
    terms = pa.array(names, pa.large_string())
    hashes = div.hashes_of(terms)
    for a, b in equal:
        hashes[a] = hashes[b]
    levels, order = div.perfect_hash(hashes)
    return div.Block({"en": (3, 1)}, [(3, levels, [names[i] for i in order])]), [names[i] for i in order]


def test_perfect_hash_is_minimal_and_verified():
    names = sorted({text(1, ["ab", "ba", "é"]) + str(i) for i in range(5000)})
    b, order = block(names)
    assert b.find("en", pa.array(order)).tolist() == list(range(len(names)))
    absent = pa.array([f"no{i}" for i in range(5000)] + ["", "日"])
    assert (b.find("en", absent) == -1).all() and b.slots("en") == (0, 5000) and b.slots("fr") == (0, 0)


def test_terms_of_equal_hash():
    names = [f"w{i}" for i in range(100)]
    levels, order = div.perfect_hash(np.array([*range(98), 5, 5], np.uint64))
    assert sorted(order.tolist()) == list(range(100)) and sum(int(np.bitwise_count(x).sum()) for x in levels) == 97
    b = div.Block({"en": (0, 1)}, [(0, div.perfect_hash(div.hashes_of(pa.array(names[:97])))[0], names)])
    found = b.find("en", pa.array(names[97:]))
    assert found.tolist() == [97, 98, 99]


def test_shares_are_exact():
    total, terms = 7 * 10**14 + 3, 10**9 + 7
    count = np.array([0, 1, 10**14, total - 1, total], np.int64)
    want = [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in count.tolist()]
    assert div.share(count, np.int64(total), terms).tolist() == want
