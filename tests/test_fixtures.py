"""Hand-made rows for each semantic trap (FIXTURES.md §2), expected values by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanpanel.operators import clean as CL
from loanpanel.operators import encode as EN
from loanpanel.operators import lender as L
from loanpanel.operators import panel as P
from loanpanel.operators import quality as Q
from loanpanel.sources import delimited as D

C = P.PanelCols(loan="loan", period="d", upb="upb", status="status", tiebreak="obs")


def _write_lines(spark, lines, name):
    path = D.staging_dir(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path + "/*.txt"


def test_first_line_is_data(spark):
    path = _write_lines(spark, ["a|1|x", "b|2|y"], "firstline")
    df = D.load_delimited(spark, path, ["k", "n", "s"])
    assert sorted(r.k for r in df.collect()) == ["a", "b"]


def test_short_long_mistyped_lines(spark):
    path = _write_lines(spark, ["b|2", "c|3|y|z", "d|q|w"], "badlines")
    skip = {r.k: r for r in D.load_delimited(spark, path, ["k", "n", "s"], col_types={"n": "int"}).collect()}
    assert set(skip) == {"b", "d"}
    assert skip["b"].n == 2 and skip["b"].s is None
    assert skip["d"].n is None and skip["d"].s == "w"
    keep = {r.k: r for r in D.load_delimited(spark, path, ["k", "n", "s"], bad_lines="keep").collect()}
    assert keep["c"].s == "y"
    with pytest.raises(Exception):
        D.load_delimited(spark, path, ["k", "n", "s"], bad_lines="error").collect()


def test_scores(spark):
    df = spark.createDataFrame([("701",), ("   ",), (None,), ("9",), ("7 1",), ("1200",)], "creditScore string")
    assert [r.creditScore for r in CL.clean_scores(df).collect()] == [701]


def test_dates(spark):
    df = spark.createDataFrame([("200601",), ("20061",), ("2006",), ("200613",)], "d string")
    out = {r.d_raw: r.d for r in CL.keep_date_shape(df.withColumn("d_raw", F.col("d")), "d").collect()}
    jan = dt.date(2006, 1, 1)
    assert out == {"200601": jan, "20061": jan, "200613": None}


def test_status_codes(spark):
    df = spark.createDataFrame([("0",), ("3",), ("R",), (None,), ("XX",)], "s string")
    assert [r.s for r in EN.status_to_number(df, "s").collect()] == [0.0, 3.0, 7.0, 0.0, 0.0]


def test_balance_codes(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ("09",), ("15",), (None,)], "z string")
    got = [r.z for r in df.select(EN.decode_zero_balance("z").alias("z")).collect()]
    assert got == ["prepaid_matured", "prepaid_matured", "REO_disposition", "00", "00"]


def _panel(spark, rows):
    return spark.createDataFrame(
        [(loan, obs, dt.date(2000, m, 1), upb, st) for loan, obs, m, upb, st in rows],
        "loan long, obs long, d date, upb double, status int")


def test_four_month_panel_has_target_and_no_history(spark):
    p = _panel(spark, [(1, i, i, 100.0 - i, s) for i, s in zip(range(1, 5), [0, 0, 0, 1])])
    loans = spark.createDataFrame([(1, 700)], "loan long, score int")
    r = P.loan_feature_table(p, loans, C).first()
    assert r.default_in_window == 1
    assert r.prev_defaults is None and r.loan_IQR is None and r.max_upb_change_rate_1 is None


def test_six_month_panel(spark):
    p = _panel(spark, [(1, i, i, 100.0 - i, s) for i, s in zip(range(1, 7), [1, 0, 0, 0, 0, 0])])
    loans = spark.createDataFrame([(1, 700)], "loan long, score int")
    split = {r.obs: r.window for r in P.history_target_split(p, C).collect()}
    assert [o for o, w in sorted(split.items()) if w == "history"] == [1, 2]
    r = P.loan_feature_table(p, loans, C).first()
    assert r.default_in_window == 0 and r.prev_defaults == 1 and r.months_in_default == 1
    assert r.loan_months_total == 6.0
    assert r.max_upb_change_rate_2 == pytest.approx(0.5)
    assert r.max_upb_change_rate_3 is None


def test_rank_ties(spark):
    p = _panel(spark, [(1, 1, 1, 10.0, 0), (1, 2, 1, 11.0, 0), (1, 3, 2, 12.0, 0)])
    ranks = sorted(r.mth_of_loan for r in P.ranked_rows(p, C).collect())
    assert ranks == [1, 1, 3]


def test_first_default_month_literal_and_corrected(spark):
    p = _panel(spark, [(1, i, i, 100.0, 2 if i == 3 else 0) for i in range(1, 7)])
    r = P.first_default_month(p, C, 60).first()
    assert r.firstDefaultMth_literal == dt.date(2000, 1, 1)
    assert r.firstDefaultMth == dt.date(2000, 3, 1)


def test_prior_default_rows_marks(spark):
    # crossing at row 4 (0-based 3): row 2 (0-based 1) is two before -> 1, row after it -> 2
    p = _panel(spark, [(1, i, i, 100.0, 2 if i == 4 else 0) for i in range(1, 7)])
    got = {r.obs: (r.prior_mth, r.mark) for r in P.prior_default_rows(p, C, 60).collect()}
    assert got[2] == (1, 1) and got[3] == (0, 2) and got[1] == (0, 0)


def test_one_servicer_has_no_leave_one_out(spark):
    df = spark.createDataFrame([("A", "m1", "2000-01", 700), ("A", "m1", "2000-01", 710),
                                ("A", "m2", "2000-01", 600), ("B", "m2", "2000-01", 650),
                                ("A", "m2", "2000-01", 620)],
                               "servicerName string, MSA string, Month string, creditScore int")
    cells = {(r.servicerName, r.MSA): r for r in L.leave_one_out_means(df).collect()}
    assert ("A", "m1") not in cells
    assert cells[("A", "m2")].pop_mean == 650.0 and cells[("B", "m2")].pop_mean == 610.0


def test_profile_drops(spark):
    rows = [(i, "same", None, "x" if i < 995 else "y") for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, const string, empty string, skewed string")
    assert Q.constant_columns(df) == ["const"]
    assert Q.all_null_columns(df) == ["empty"]
    kept = Q.remove_homogeneity(df, 0.99).columns
    assert "skewed" not in kept and "const" not in kept and "k" in kept


def test_null_msa_kept_at_loan_level(spark):
    df = spark.createDataFrame([(1, None, 700), (2, "m", 650), (3, "m", 660)],
                               "loan long, MSA string, creditScore int")
    out = {r.loan: r for r in L.score_outliers(df, date=None).collect()}
    assert out[1].MSACreditScore_mean is None
    assert [r.MSA for r in L.msa_score_spread(df).collect()] == ["m"]
