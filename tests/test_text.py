import random

from pyspark.sql import functions as F

from corpusflow.functions.text import collapse_whitespace, lexical_score, snippet, strip, tokens

SPACES = [chr(c) for c in range(0x3100) if chr(c).isspace()]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def random_texts(n, seed=7):
    rng = random.Random(seed)
    letters = list("abcXYZäß€,.ÄÉ😀") + SPACES
    return ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(n)] + ["", " ", "　"]


def test_there_are_29_kinds_of_whitespace(spark):
    assert len(SPACES) == 29
    assert column(spark, [f"a{s}b" for s in SPACES], tokens) == [["a", "b"]] * 29


def test_words_and_stripping_match_python(spark):
    texts = random_texts(300)
    assert column(spark, texts, tokens) == [list(dict.fromkeys(t.lower().split())) for t in texts]
    assert column(spark, texts, strip) == [t.strip() for t in texts]
    assert column(spark, texts, collapse_whitespace) == [" ".join(t.split()) for t in texts]


def test_snippet_edges(spark):
    cases = {
        "  a \n\t b  ": "a b",
        "abcdefgh": "abcdefgh",
        "abcdefghi": "abcdefg…",
        "abcdef ghi": "abcdef…",
        "": "",
        " \n ": "",
        None: "",
    }
    assert column(spark, list(cases), lambda c: snippet(c, 8)) == list(cases.values())


def test_snippet_of_random_texts(spark):
    def expected(text, n):
        line = " ".join(text.split())
        return line if len(line) <= n else line[: n - 1].rstrip() + "…"

    texts = random_texts(300, 8)
    assert column(spark, texts, lambda c: snippet(c, 12)) == [expected(t, 12) for t in texts]


def test_lexical_score(spark):
    rows = [
        ("", "x", 0.0), ("  ", "x", 0.0), (None, "x", 0.0), ("a", None, 0.0),
        ("Berlin Berlin", "in BERLIN", 1.0), ("Berlin", "Berlin, Mitte", 0.0), ("a b c d", "a x c", 0.5),
    ]
    df = spark.createDataFrame(rows, "q string, d string, e double")
    assert all(r.s == r.e for r in df.select("e", lexical_score(F.col("q"), F.col("d")).alias("s")).collect())


def test_words_and_snippets_are_not_split_by_a_class_of_characters(spark):
    """A regex over all 29 characters took most of the time of scoring hits."""
    df = spark.createDataFrame([("a b", "b\u2003\x1cc b")], "q string, d string")
    scored = df.select(lexical_score(F.col("q"), F.col("d")).alias("s"), snippet(F.col("d")).alias("n"))
    assert "2028" not in (plan := scored._jdf.queryExecution().optimizedPlan().toString()) and "translate" in plan
    assert tuple(scored.first()) == (0.5, "b c b")
