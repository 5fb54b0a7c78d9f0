"""Deduplication of candidates and their places."""

from tablewright.operators import candidates

ROWS = [
    ("a", "x", 1.0, 7), ("a", "x", 2.0, 9), ("a", "x", 2.0, 8), ("a", None, None, 3), ("a", None, 0.5, 30),
    (None, "x", None, 1), (None, "x", None, 0), ("a", "y", 5.0, 900), ("a", "z", 5.0, 12),
]
WANT = [
    ("a", None, 0.5, 30, 0), ("a", "x", 2.0, 8, 1), ("a", "z", 5.0, 12, 2), ("a", "y", 5.0, 900, 3), (None, "x", None, 0, 0),
]


def kept(spark, rows, width):
    df = spark.createDataFrame(rows, "k string, s string, score double, ord int")
    return sorted(map(tuple, candidates.dedupe(df, ["k"], ["s"], "score", width=width).collect()), key=str)


def test_dedupe_keeps_the_first_of_the_best_at_the_first_place(spark):
    assert kept(spark, ROWS, None) == sorted(WANT, key=str)


def test_dedupe_by_stretches_gives_the_same_places(spark):
    assert kept(spark, ROWS, 10) == sorted(WANT, key=str)
    assert kept(spark, [], 10) == []
