"""The default-prediction flow on files in the loan layouts, with the loan
files' own column names (no binding): load -> prep -> combine -> features ->
split -> model -> result tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from loanpanel import schema as S
from loanpanel.operators import joins as J
from loanpanel.operators import model as M
from loanpanel.operators import panel as P
from loanpanel.operators import prep as PR
from loanpanel.plans import driver_tables as T
from loanpanel.sources import delimited as D


def _line(values, columns):
    return F.concat_ws("|", *[F.coalesce(values.get(c, F.lit(None)).cast("string"), F.lit(""))
                              for c in columns])


def test_default_prediction_flow(spark):
    base = D.staging_dir(spark, "e2e")
    c = T.table(spark, SF_SMALL, "customer")
    o = T.table(spark, SF_SMALL, "orders")
    orig = {
        "creditScore": (F.lit(300) + (F.col("c_custkey") * 37) % 551),
        "firstPaymentDate": F.lit("200601"), "maturityDate": F.lit("203601"),
        "MSA": F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")), "origUPB": F.col("c_acctbal"),
        "origCLTV": F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.lit("80")),
        "origDTI": F.lit("   "), "channel": F.substring("c_mktsegment", 1, 1), "loanSeqNumber": F.col("c_custkey"),
        "origLoanTerm": F.lit("360"), "borrowers": F.lit("1"), "servicerName": F.col("c_mktsegment"),
    }
    c.select(_line(orig, S.ORIGINATION_COLUMNS).alias("value")).write.text(f"{base}/orig")
    month = {
        "loanSeqNumber": F.col("o_custkey"), "mthlyRepPeriod": F.date_format("o_orderdate", "yyyyMM"),
        "currUPB": F.col("o_totalprice"),
        "currLoanDelinqStatus": (F.lit(5) - F.substring("o_orderpriority", 1, 1).cast("int")),
        "zeroBalanceCode": F.when(F.col("o_orderkey") % 10 == 0, F.lit("1.0")),
    }
    o.select(_line(month, S.MONTHLY_COLUMNS).alias("value")).write.text(f"{base}/monthly")

    origination = PR.prep_origination(D.load_origination(spark, f"{base}/orig"))
    monthly = PR.prep_monthly(D.load_monthly(spark, f"{base}/monthly"))
    assert "Unknown" not in monthly.columns and "origCLTV" in origination.columns
    panel = J.combine(origination.select("loanSeqNumber", "creditScore", "origUPB"), monthly)

    # several rows of a loan share a month here: the tie-break keeps the order deterministic
    cols = P.PanelCols(tiebreak="currUPB")
    loans = panel.select("loanSeqNumber", "creditScore", "origUPB").distinct()
    feats = P.loan_feature_table(panel, loans, cols, drop_incomplete=True)
    assert feats.count() > 0 and feats.select("loanSeqNumber").distinct().count() == feats.count()

    split = M.train_test_split(feats, "loanSeqNumber")
    features = ["creditScore", "origUPB", "loan_months_total", "prev_defaults", "UPB_var"]
    model = M.fit_logistic(split.where(~F.col("is_test")), features, "default_in_window")
    pred = M.predict(model, split.where("is_test"), features)
    res = M.residual_table(pred, "default_in_window")
    shares = M.result_shares(res, "default_in_window").first()
    counts = M.confusion_counts(res, "default_in_window").first()
    assert counts.n == counts.tp + counts.tn + counts.fp + counts.fn
    assert abs(shares.pct_match - counts.matches / counts.n) < 1e-12
