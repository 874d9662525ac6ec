from corpusflow.functions.vectors import pool_first, validate_vectors


def test_pooling(spark):
    one = lambda kind, value: pool_first(spark.createDataFrame([(value,)], f"o {kind}"), "o").first().embedding
    three, two, flat = "array<array<array<double>>>", "array<array<double>>", "array<double>"
    assert one(three, [[[1.0, 2.0], [3.0, 4.0]]]) == [1.0, 2.0]
    assert one(two, [[1.0, 2.0], [3.0, 4.0]]) == [1.0, 2.0]
    assert one(flat, [1.0, 2.0]) == [1.0, 2.0]
    for kind, value in [(three, []), (three, [[]]), (two, []), (two, [[]]), (flat, [])]:
        assert one(kind, value) is None


def test_validation(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, float("nan")]), (5, [1.0, float("inf")]), (6, [None, 1.0])]
    good, bad = validate_vectors(spark.createDataFrame(rows, "i int, embedding array<double>"), 2)
    assert [r.i for r in good.collect()] == [1]
    assert good.schema["embedding"].dataType.simpleString() == "array<float>"
    assert {r.i: r.reason for r in bad.collect()} == {
        2: "dimension 1", 3: "missing vector", 4: "component not finite", 5: "component not finite",
        6: "component not finite",
    }
