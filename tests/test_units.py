"""Small operators without a registered query of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from loanpanel.operators import clean as CL
from loanpanel.operators import encode as EN
from loanpanel.operators import joins as J
from loanpanel.operators import panel as P
from loanpanel.operators import prep as PR
from loanpanel.operators import quality as Q
from loanpanel.plans import driver_tables as T


def test_clean_observations_by_source(spark):
    df = spark.createDataFrame([("701", "200601"), ("9", "200602"), ("650", "2006")],
                               "creditScore string, firstPaymentDate string")
    out = CL.clean_observations(df, "freddie").collect()
    assert [(r.creditScore, r.firstPaymentDate) for r in out] == [(701, dt.date(2006, 1, 1))]
    assert CL.clean_observations(df, "acs") is None
    with pytest.raises(ValueError):
        CL.clean_observations(df, "other")


def test_assert_not_null_and_unique(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "c")], "k long, v string")
    Q.assert_not_null(df, ["k"])
    with pytest.raises(ValueError):
        Q.assert_not_null(df, ["v"])
    with pytest.raises(ValueError):
        Q.assert_unique(df, ["k"])
    with pytest.raises(ValueError):
        J.add_loan_features(df.select("k").distinct(), df, "k")


def test_constant_and_per_column_median_fill(spark):
    df = spark.createDataFrame([("L1", "80", None), ("L2", None, "30"), ("L3", "90", "   ")],
                               "loanSeqNumber string, origCLTV string, origDTI string")
    out = {r.loanSeqNumber: r for r in PR.prep_origination(df).collect()}
    assert out["L2"].origCLTV == 85.0          # its own median, not another column's
    assert out["L3"].origDTI == 0.0 and out["L1"].origDTI is None
    assert EN.add_constant(df).select("const").distinct().first()[0] == 1.0


def test_all_widths_matches_longest_history(spark):
    p = T.panel(spark, SF_SMALL)
    widths = P.all_widths(p, T.PANEL_COLS)
    hist = P.ranked_rows(p, T.PANEL_COLS).where("in_history").groupBy("loan").count()
    assert widths == list(range(1, hist.agg(F.max("count")).first()[0]))


def test_drop_incomplete_is_listwise(spark):
    p = T.panel(spark, SF_SMALL)
    loans = T.loans(spark, SF_SMALL).select("loan", "score")
    full = P.loan_feature_table(p, loans, T.PANEL_COLS)
    kept = P.loan_feature_table(p, loans, T.PANEL_COLS, drop_incomplete=True)
    assert kept.count() == full.dropna().count() < full.count()


def test_union_all_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "k long, a string")
    b = spark.createDataFrame([(2, 3.0)], "k long, b double")
    rows = sorted(J.union_all([a, b]).collect(), key=lambda r: r.k)
    assert rows[0].b is None and rows[1].a is None and rows[1].b == 3.0
