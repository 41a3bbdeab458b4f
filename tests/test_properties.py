"""Property tests: random small panels through the Spark feature table
against a direct pandas computation of the same definitions."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loanpanel.operators import panel as P

C = P.PanelCols(loan="loan", period="d", upb="upb", status="status", tiebreak="obs")
WIDTHS = (1, 2, 3)

row = st.tuples(st.integers(1, 4),            # loan
                st.integers(0, 9),            # day offset (many ties)
                st.floats(0, 1000, allow_nan=False).map(lambda x: round(x, 2)),
                st.integers(0, 3))            # status


def brute_force(df: pd.DataFrame) -> dict:
    out = {}
    for loan, g in df.groupby("loan"):
        g = g.sort_values(["d", "obs"]).copy()
        g["mth"] = g["d"].rank(method="min").astype(int)
        total = g["mth"].max()
        hist = g[g["mth"] < total - 3]
        tgt = g[g["mth"] >= total - 3]
        rec = {"default_in_window": int(tgt["status"].max() > 0)}
        if len(hist):
            rec["prev_defaults"] = int(hist["status"].max() > 0)
            rec["months_in_default"] = int((hist["status"] > 0).sum())
            rec["loan_months_total"] = float(total)
            u = hist["upb"].to_numpy()
            rec["loan_IQR"] = float(np.percentile(u, 75) - np.percentile(u, 25))
            rec["loan_Range"] = float(u.max() - u.min())
            rec["UPB_var"] = float(np.var(u, ddof=1)) if len(u) > 1 else None
            for m in WIDTHS:
                if len(u) >= m:
                    s = pd.Series(u)
                    rate = (s.rolling(m, min_periods=m).max() - s.rolling(m, min_periods=m).min()) / m
                    rec[f"max_upb_change_rate_{m}"] = float(rate.max())
                else:
                    rec[f"max_upb_change_rate_{m}"] = None
        else:
            for c in ("prev_defaults", "months_in_default", "loan_months_total", "loan_IQR", "loan_Range",
                      "UPB_var", *[f"max_upb_change_rate_{m}" for m in WIDTHS]):
                rec[c] = None
        out[loan] = rec
    return out


def _same(a, b):
    if a is None or b is None or (isinstance(a, float) and math.isnan(a)):
        return (a is None or (isinstance(a, float) and math.isnan(a))) and b is None
    return a == pytest.approx(b, rel=1e-9, abs=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=60), st.sampled_from([1, 2, 1_000_000]))
def test_feature_table_matches_brute_force(spark, rows, chunk):
    base = dt.date(2001, 1, 1)
    data = [(loan, i, base + dt.timedelta(days=day), upb, s) for i, (loan, day, upb, s) in enumerate(rows)]
    pdf = pd.DataFrame(data, columns=["loan", "obs", "d", "upb", "status"])
    sdf = spark.createDataFrame(data, "loan long, obs long, d date, upb double, status int")
    loans = sdf.select("loan").distinct()
    got = {r.loan: r.asDict() for r in P.loan_feature_table(sdf, loans, C, widths=WIDTHS,
                                                            chunk_rows=chunk).collect()}
    want = brute_force(pdf)
    assert set(got) == set(want)
    for loan, rec in want.items():
        for col, val in rec.items():
            assert _same(got[loan][col], val), (loan, col, got[loan][col], val)


cell_row = st.tuples(st.sampled_from(["A", "B", "C", "Other servicers"]),   # servicer
                     st.sampled_from(["m1", "m2"]),                          # MSA
                     st.sampled_from(["2001-01", "2001-02"]),                # month
                     st.integers(300, 850))                                  # score


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(cell_row, min_size=1, max_size=80))
def test_leave_one_out_ttest_matches_brute_force(spark, rows):
    from loanpanel.operators import lender as L
    df = spark.createDataFrame(rows, "servicerName string, MSA string, Month string, creditScore int")
    got = {(r.servicerName, r.MSA, r.Month): r for r in L.adverse_selection_ttest(df).collect()}
    pdf = pd.DataFrame(rows, columns=["servicerName", "MSA", "Month", "creditScore"])
    pdf = pdf[pdf.servicerName != "Other servicers"]
    want = {}
    for (s, m, mo), g in pdf.groupby(["servicerName", "MSA", "Month"]):
        others = pdf[(pdf.MSA == m) & (pdf.Month == mo) & (pdf.servicerName != s)]
        if len(others) == 0 or len(g) < 2:
            continue
        mean, sd, n = g.creditScore.mean(), g.creditScore.std(ddof=1), len(g)
        pop = others.creditScore.mean()
        if sd == 0 and mean == pop:
            continue
        want[(s, m, mo)] = None if sd == 0 else (mean - pop) / (sd / math.sqrt(n))
    assert set(got) == set(want)
    for key, t in want.items():
        assert _same(got[key].t, t)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 3)), min_size=1, max_size=40),
       st.sampled_from([1, 3, 1_000_000]))
def test_prior_default_marks_match_shift_semantics(spark, rows, chunk):
    base = dt.date(2001, 1, 1)
    data = [(loan, i, base + dt.timedelta(days=i), 1.0, s) for i, (loan, s) in enumerate(rows)]
    sdf = spark.createDataFrame(data, "loan long, obs long, d date, upb double, status int")
    got = {r.obs: (r.prior_mth, r.mark) for r in P.prior_default_rows(sdf, C, 60, chunk_rows=chunk).collect()}
    want = {}
    pdf = pd.DataFrame(data, columns=["loan", "obs", "d", "upb", "status"])
    for loan, g in pdf.groupby("loan"):
        crossed = (g.sort_values(["d", "obs"]).status >= 2).astype(int).tolist()
        if not any(crossed):
            continue
        obs = g.sort_values(["d", "obs"]).obs.tolist()
        prior = [1 if i + 2 < len(crossed) and crossed[i + 2] == 1 else 0 for i in range(len(crossed))]
        for i, o in enumerate(obs):
            mark = 2 if i > 0 and prior[i - 1] == 1 else prior[i]
            want[o] = (prior[i], mark)
    assert got == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 500), min_size=1, max_size=120), st.integers(1, 9), st.integers(1, 40))
def test_bins_match_row_number_definition(spark, keys, parts, cap):
    from loanpanel.sources import bins as B
    df = spark.createDataFrame([(k,) for k in keys], "loanSeqNumber long")
    idx = {r.loanSeqNumber: r.idx for r in B.dense_index(df, "loanSeqNumber", partitions=parts).collect()}
    assert idx == {k: i for i, k in enumerate(sorted(set(keys)))}
    m = {r.loanSeqNumber: (r.binNumber, r.binOccupancy) for r in B.create_bins(df, capacity=cap).collect()}
    n = len(set(keys))
    for k, i in idx.items():
        b = i // cap
        assert m[k] == (b, min(cap, n - b * cap))
