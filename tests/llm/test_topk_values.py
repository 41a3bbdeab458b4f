"""op8 on values the tables lack: large components, ties, nulls, repeated ids, unequal lengths, an empty table."""

import math

import pytest
from pyspark.sql import functions as F

from loanpanel.llm import topk

SCHEMA = "vec_id long, embedding array<double>, `odd.name` int, rank string"


def brute(rows, is_query, k, scale=256):
    good = [(i, [math.floor(x * scale) for x in v]) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if is_query(i)}):
        x = min(v for i, v in good if i == q)
        scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in good if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def found(spark, rows, k=3, modulus=2, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = topk.top_k(df, F.col("vec_id") % modulus == 0, k=k, **options)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


def test_large_components_rank_exactly(spark):
    rows = [(0, [4e13, 1.0], 1, "a"), (1, [3e-3, 7.0], 1, "a"), (2, [-2.0, 5.0], 1, "a"), (3, [2.0, 2.0 ** 40 + 1], 1, "a"), (4, [0.0, -1.0], 1, "a"),
            (5, [1.0, 0.5], 1, "a"), (7, [0.0, 9.0], 1, "a"), (9, [-1.0, 2.0 ** 44 + 256], 1, "a")]
    assert found(spark, rows) == brute(rows, lambda i: i % 2 == 0, 3)
    assert any(r[0] == 0 for r in found(spark, rows)) and max(abs(r[3]) for r in found(spark, rows)) > 2 ** 53


def test_what_no_long_holds_is_an_error(spark):
    for rows in ([(0, [1e17], 1, "a"), (1, [1.0], 1, "a")], [(0, [4e13], 1, "a"), (1, [4e13], 1, "a")]):
        with pytest.raises(Exception, match="fit a long"):
            found(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1, "a"), (0, [1.0, 2.0], 1, "a"), (2, [1.0, 1.0], 1, "a"), (1, [1.0, 1.0], 1, "a"), (3, [1.0, 1.0], 1, "a"),
            (5, [1.0], 1, "a"), (6, [0.5, 0.25, 9.0], 1, "a"), (8, None, 1, "a"), (10, [nan, 1.0], 1, "a"), (11, [1.0, inf], 1, "a"),
            (12, [None, 1.0], 1, "a"), (None, [5.0, 5.0], 1, "a"), (14, [], 1, "a"), (7, [-3.0, -3.0], 1, None)]
    for k, block in ((1, 2048), (3, 2), (50, 1)):
        assert found(spark, rows, k=k, block=block) == brute(rows, lambda i: i % 2 == 0, k)
    assert found(spark, [(0, [1.0], 1, "a")]) == [] and found(spark, [(1, [1.0], 1, "a")]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(empty, F.col("vec_id") % 2 == 0).collect() == []
