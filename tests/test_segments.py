"""Segments of an order, quantiles by rank and rates of all widths against plain definitions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanpanel.functions.segments import grouped_quantiles, with_segment
from loanpanel.operators import panel as P
from loanpanel.operators.widths import rates_by_width, rates_of_all_widths

C = P.PanelCols(loan="loan", period="d", upb="upb", status="status", tiebreak="obs")


def plain_rates(v):
    out = []
    for m in range(1, len(v) + 1):
        frames = [v[i:i + m] for i in range(len(v) - m + 1)]
        out.append(max(((max(f) - min(f)) / m for f in frames if not any(x is None for x in f)), default=None))
    return out


@pytest.mark.parametrize("parts", [2, 40])
def test_quantiles_by_rank(spark, parts):
    rng = random.Random(parts)
    rows = []
    for g in ["a", "b", None, "only null", "one"]:
        for _ in range({"one": 1, "a": 200}.get(g, 60)):
            v = None if g == "only null" or rng.random() < .1 else float(rng.choice([rng.randrange(9), rng.random() * 1e6, -3]))
            rows.append((g, 1 if g is None else 2, v))
    rows += [("a", 2, 5.0)] * 300 + [("b", 2, float("nan"))] * 3
    qs = {"low": 0.0, "p25": 0.25, "mid": 0.5, "p99": 0.99, "high": 1.0}
    got = {r["g"]: tuple(r[k] for k in qs) for r in grouped_quantiles(spark.createDataFrame(rows, "g string, h int, v double"), ["g", "h"], "v", qs, parts).collect()}
    assert set(got) == {g for g, _, v in rows if v is not None and v == v}
    for g, found in got.items():
        v = [x for k, _, x in rows if k == g and x is not None and x == x]
        assert found == pytest.approx([np.percentile(v, 100 * q) for q in qs.values()], rel=1e-12)


def test_quantiles_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "g long, v double")
    assert grouped_quantiles(empty, ["g"], "v", {"p": 0.5}).collect() == []


@pytest.mark.parametrize("kind,values", [
    ("string", ["", "a", "ab", "zz", "é", "aaaaaaaaab", "aaaaaaaaac", None]),
    ("date", [dt.date(1969, 1, 1), dt.date(2020, 5, 5), dt.date(2020, 5, 6), None]),
    ("timestamp", [dt.datetime(2020, 5, 5, 1), dt.datetime(2020, 5, 5, 2), None]),
    ("bigint", [-5, 0, 3, 2**60, None]),
    ("decimal(20,2)", None)])
def test_segments_follow_the_order(spark, kind, values):
    base = spark.range(400)
    df = (spark.createDataFrame([(v,) for v in values for _ in range(20)], f"v {kind}") if values
          else base.select((F.col("id") * 7 % 31).cast(kind).alias("v")))
    got = with_segment(df, "v", "seg", 5).orderBy("v").collect()
    segs = [r["seg"] for r in got]
    assert segs == sorted(segs) and len(set(segs)) > 1


@pytest.mark.parametrize("block_rows", [1, 8, 4096])
def test_rates_of_all_widths(spark, block_rows):
    rng = random.Random(5)
    rows, wanted = [], {}
    for loan in range(9):
        v = [None if loan % 3 == 0 and rng.random() < .08 else float(rng.randrange(90)) for _ in range(rng.randint(1, 50))]
        wanted[loan] = plain_rates(v)
        rows += [(loan, i, x, len(v)) for i, x in enumerate(v)]
    rng.shuffle(rows)
    got = {r["loan"]: r["rates"] for r in rates_of_all_widths(spark.createDataFrame(rows, "loan long, pos long, upb double, n long"), block_rows).collect()}
    for loan, rates in wanted.items():
        found = got.get(loan, [])
        assert found + [None] * (len(rates) - len(found)) == rates


def test_rates_of_several_series_at_once():
    rng = np.random.default_rng(2)
    for _ in range(100):
        lengths = rng.integers(1, 20, rng.integers(1, 7))
        values = rng.integers(0, 40, lengths.sum()).astype(float)
        values[rng.random(len(values)) < .05] = np.nan
        at = 0
        for n, found in zip(lengths, rates_by_width(values, lengths)):
            plain = plain_rates([None if np.isnan(x) else x for x in values[at:at + n]])
            assert [None if np.isnan(x) else x for x in found] == plain
            at += n


def hot_panel(spark):
    """A third of the rows in one (loan, period), a third in the other periods of that loan."""
    rows, day = [], dt.date(2020, 1, 1)
    for i in range(900):
        loan, d = (1, day) if i % 3 == 0 else (1, day + dt.timedelta(i % 50)) if i % 3 == 1 else (2 + i % 40, day + dt.timedelta(i % 7))
        rows.append((loan, i * 31 % 900, d, float(i * 17 % 101), i * 7 % 5 - 2 if i % 11 == 0 else 0))
    return spark.createDataFrame(rows, "loan long, obs long, d date, upb double, status int")


@pytest.mark.parametrize("segments", [4, 64])
def test_positions_of_a_hot_loan(spark, segments):
    panel = hot_panel(spark)
    got = P.ranked_rows(panel, C, segments=segments).collect()
    by_loan = {}
    for r in got:
        by_loan.setdefault(r["loan"], []).append(r)
    assert len(got) == 900
    for rows in by_loan.values():
        rows.sort(key=lambda r: (r["d"], r["obs"]))
        assert [r["pos"] for r in rows] == list(range(len(rows)))
        ranks = [sum(x["d"] < r["d"] for x in rows) + 1 for r in rows]
        assert [r["mth_of_loan"] for r in rows] == ranks
        history = sum(k < max(ranks) - 3 for k in ranks)
        assert {r["history_rows"] for r in rows} == {history} and [r["in_history"] for r in rows] == [k < max(ranks) - 3 for k in ranks]


@pytest.mark.parametrize("segments,chunk", [(1, 4096), (16, 50)])
def test_features_of_a_hot_loan(spark, segments, chunk):
    panel = hot_panel(spark)
    loans = panel.select("loan").distinct()
    got = {r["loan"]: r for r in P.loan_feature_table(panel, loans, C, segments=segments, chunk_rows=chunk).collect()}
    long = {(r["loan"], r["width"]): r["max_upb_change_rate"] for r in P.upb_change_rate_all_widths(panel, C, segments=segments, chunk_rows=chunk).collect()}
    rows = sorted(map(tuple, panel.collect()), key=lambda r: (r[0], r[2], r[1]))
    history = {}
    for loan in got:
        own = [r for r in rows if r[0] == loan]
        ranks = [sum(x[2] < r[2] for x in own) + 1 for r in own]
        history[loan] = [r[3] for r, k in zip(own, ranks) if k < max(ranks) - 3]
    most = max(map(len, history.values()))
    for loan, v in history.items():
        rates = plain_rates(v)[:most - 1]
        assert (got[loan]["max_upb_change_rates"] or []) == rates
        assert [long.get((loan, m)) for m in range(1, len(rates) + 1)] == rates
        iqr = np.percentile(v, 75) - np.percentile(v, 25) if v else None
        assert got[loan]["loan_IQR"] == (pytest.approx(iqr) if v else None)


def test_labels_of_very_many_values_and_a_hot_one(spark):
    from loanpanel.operators import encode as EN
    rows = [(i, None if i % 50 == 7 else "hot" if i % 3 == 0 else f"v{i * 7919 % 20_000:05d}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "id long, code string")
    order = {v: k for k, v in enumerate(sorted({v for _, v in rows if v is not None}))}
    assert len(order) > 10_000
    got = {r["id"]: r["code"] for r in EN.label_encode(df, "code").collect()}
    assert got == {i: len(order) if v is None else order[v] for i, v in rows}
    filled = EN.label_encode(df.limit(10), "code", out="label", fill="v")
    assert filled.columns == ["id", "code", "label"] and filled.where("label is null").count() == 0
    assert EN.label_encode(df.where("false"), "code").collect() == []


def test_values_of_several_columns_at_once(spark):
    from loanpanel.operators import encode as EN
    df = spark.createDataFrame([("a", "x"), ("b", None), ("a", "y")], "p string, q string")
    assert EN.observed_values_of(df, ["p", "q"]) == {"p": ["a", "b"], "q": ["x", "y"]}
    with pytest.raises(ValueError):
        EN.observed_values_of(df, ["p", "q"], max_values=1)
