"""Model queries (J3, J4, K1-K11) on the loan feature table.

The model input is the ``loan_features`` result (rounded as published), so
the Spark side and the SQL oracle see bit-identical feature values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loanpanel.functions.exprs import rnd
from loanpanel.operators import model as M
from loanpanel.operators import select as SEL
from loanpanel.plans import driver_tables as T
from loanpanel.plans.q_panel import FEATURE_CTE, loan_features
from loanpanel.plans.registry import query
from loanpanel.session import cut_lineage

LABEL = "default_in_window"
FEATURES = ["score", "prev_defaults", "loan_months_total", "loan_IQR", "loan_Range", "UPB_var",
            "max_upb_change_rate_2", "max_upb_change_rate_3"]
KS = list(range(1, 11))


def model_frame(spark, sf_dir):
    """Loans with every feature present (listwise deletion, B11), staged: the fits read it many times."""
    return cut_lineage(loan_features(spark, sf_dir).select("loan", LABEL, *FEATURES).dropna())


def _split(spark, sf_dir):
    return M.train_test_split(model_frame(spark, sf_dir), "loan")


_HASH_SQL = "(('0x' || substr(md5('7-' || cast(loan as varchar)), 1, 8))::bigint % 100) < 33"


@query("split", T.with_ctes("loans") + f"""
select loan, {_HASH_SQL} as is_test from loans""")
def split(spark, sf_dir):
    """K1: hash split of the loans, 33 % test, seed 7."""
    return M.train_test_split(T.loans(spark, sf_dir).select("loan"), "loan")


def _mant_exp_sql(v: str) -> str:
    e = f"cast(floor(log10(abs({v}))) as int)"
    return (f"case when {v} = 0 then 0.0 else round({v} / pow(10, {e}), 9) end as mantissa, "
            f"case when {v} = 0 then 0 else {e} end as exponent")


@query("gram", FEATURE_CTE + """,
d as (select * from feat where """ + " and ".join(f"{f} is not null" for f in FEATURES) + """),
g as (""" + "\nunion all\n".join(
    f"select '{a}' as col_i, '{FEATURES[j]}' as col_j, sum(cast({a} as double) * cast({FEATURES[j]} as double)) as v from d"
    for i, a in enumerate(FEATURES) for j in range(i, len(FEATURES))) + f""")
select col_i, col_j, {_mant_exp_sql('v')} from g""")
def gram(spark, sf_dir):
    """J3's distributed pass: X'X as (col_i, col_j) with 9 significant digits."""
    g = SEL.gram_long(model_frame(spark, sf_dir), FEATURES)
    v = F.col("value")
    e = F.floor(F.log10(F.abs(v))).cast("int")
    return g.select("col_i", "col_j",
                    F.when(v == 0, F.lit(0.0)).otherwise(rnd(v / F.pow(F.lit(10.0), e), 9)).alias("mantissa"),
                    F.when(v == 0, F.lit(0)).otherwise(e).alias("exponent"))


def _vif_sql(thresh: float) -> str:
    """The elimination by recursion: ``inv`` inverts the scaled Gram matrix one pivot at a time, ``cut`` drops the
    column of the largest diagonal element and sweeps it out (its row becomes zero)."""
    p, names = len(FEATURES), ", ".join(f"'{f}'" for f in FEATURES)
    cell = lambda i, j: f"sum(cast({FEATURES[i]} as double) * cast({FEATURES[j]} as double))"
    rows = ", ".join("[" + ", ".join(cell(i, j) for j in range(p)) + "]" for i in range(p))
    each = lambda body: f"list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 1}), lambda j: {body}))"
    invert = each("case when i = k and j = k then 1 / a[k][k] when i = k then a[k][j] / a[k][k] "
                  "when j = k then -a[i][k] / a[k][k] else a[i][j] - a[i][k] * a[k][j] / a[k][k] end")
    sweep = each("case when i = m or j = m then 0 else a[i][j] - a[i][m] * a[m][j] / a[m][m] end")
    diagonal = f"list_transform(range(1, {p + 1}), lambda i: a[i][i])"
    return FEATURE_CTE.replace("with ", "with recursive ", 1) + f""",
d as (select * from feat where """ + " and ".join(f"{f} is not null" for f in FEATURES) + f"""),
g as (select [{rows}] as g from d),
inv(k, a) as (
  select cast(1 as bigint), {each("g[i][j] / sqrt(g[i][i] * g[j][j])")} from g
  union all select k + 1, {invert} from inv where k <= {p}),
cut(round, m, a, top) as (
  select 0, list_position({diagonal}, list_max({diagonal})), a, list_max({diagonal}) from inv where k = {p + 1}
  union all
  select round + 1, list_position({diagonal}, list_max({diagonal})), a, list_max({diagonal})
  from (select round, {sweep} as a from cut where top > {thresh} and round < {p - 1})),
dropped as (select round + 1 as round, m from cut where top > {thresh} and round < {p - 1}),
last as (select a from cut order by round desc limit 1)
select [{names}][i] as column_name, case when dropped.m is null then round(a[i][i], 6) end as vif,
       cast(dropped.round as int) as dropped_round
from last, range(1, {p + 1}) r(i) left join dropped on dropped.m = r.i"""


def _vif_rows(spark, sf_dir, **options):
    return (SEL.vif_table(model_frame(spark, sf_dir), FEATURES, **options)
            .select("column_name", rnd("vif", 6).alias("vif"), "dropped_round"))


@query("vif", _vif_sql(20.0))
def vif(spark, sf_dir):
    """VIF elimination at threshold 20."""
    return _vif_rows(spark, sf_dir, thresh=20.0)


@query("vif_strict", _vif_sql(2.0))
def vif_strict(spark, sf_dir):
    """Infinite VIFs removed first (none in these columns), then elimination at threshold 2."""
    return _vif_rows(spark, sf_dir, thresh=2.0, drop_infinite_first=True)


@query("logit")
def logit(spark, sf_dir):
    """K2 + K6: logistic regression on the training loans; coefficient table."""
    s = _split(spark, sf_dir)
    model = M.fit_logistic(s.where(~F.col("is_test")), FEATURES, LABEL)
    return M.coefficient_table(model, FEATURES)


@query("logit_residuals")
def logit_residuals(spark, sf_dir):
    """K2 + K8: residual table of the logistic model on the test loans."""
    s = _split(spark, sf_dir)
    model = M.fit_logistic(s.where(~F.col("is_test")), FEATURES, LABEL)
    pred = M.predict(model, s.where("is_test"), FEATURES)
    return M.residual_table(pred, LABEL).select("loan", LABEL, "Y_hat", "falsePosPred", "falseNegPred", "match")


@query("boosted")
def boosted(spark, sf_dir):
    """K3 + K7: gradient-boosted trees; feature importance table."""
    s = _split(spark, sf_dir)
    model = M.fit_boosted(s.where(~F.col("is_test")), FEATURES, LABEL)
    return M.importance_table(model, FEATURES)


@query("forest")
def forest(spark, sf_dir):
    """K4: random forest (1,000 trees); feature importance table."""
    s = _split(spark, sf_dir)
    model = M.fit_forest(s.where(~F.col("is_test")), FEATURES, LABEL)
    return M.importance_table(model, FEATURES)


def _neighbours(spark, sf_dir):
    # the feature table feeds several passes (statistics, quantiles, rounds,
    # scoring): materialise it once in the shared checkpoint folder
    from loanpanel.session import cut_lineage
    s = cut_lineage(_split(spark, sf_dir))
    train, test = s.where(~F.col("is_test")), s.where("is_test")
    return M.knn_neighbors(train, test, "loan", FEATURES, LABEL, k=max(KS)), test


# The oracle is plain brute force (every test row against every training row),
# run by DuckDB only; the Spark side never forms that product.
_SQD = " + ".join(f"(te.{f} - tr.{f}) * (te.{f} - tr.{f})" for f in FEATURES)
_KNN_SQL = FEATURE_CTE + f""",
d as (select * from feat where """ + " and ".join(f"{f} is not null" for f in FEATURES) + f"""),
sp as (select *, {_HASH_SQL} as is_test from d),
tr as (select * from sp where not is_test), te as (select * from sp where is_test),
nb as (select te.loan as q, te.{LABEL} as y, tr.loan as t, tr.{LABEL} as tl,
              row_number() over (partition by te.loan order by {_SQD}, tr.loan) as rk
       from te cross join tr qualify rk <= {max(KS)}),
votes as (select q, any_value(y) as y, """ + ", ".join(
    f"sum(case when rk <= {k} then tl else 0 end) as o{k}" for k in KS) + """ from nb group by q),
pred as (select q, y, """ + ", ".join(f"case when o{k} * 2 > {k} then 1 else 0 end as p{k}" for k in KS) + """
         from votes)"""


@query("knn", _KNN_SQL + "\n" + "\nunion all\n".join(
    f"select {k} as k, round(avg(case when p{k} = y then 1.0 else 0.0 end), 6) as accuracy from pred" for k in KS))
def knn(spark, sf_dir):
    """K5: exact k-NN vote accuracy for k = 1..10 (oracle: brute force over all pairs)."""
    neigh, test = _neighbours(spark, sf_dir)
    acc = M.knn_accuracy(neigh, test, "loan", LABEL, KS)
    return acc.select("k", rnd("accuracy", 6).alias("accuracy"))


_KNN_RES_SQL = _KNN_SQL + f""",
res as (select q as loan, y as {LABEL}, p10 as Y_hat,
               case when p10 = 1 and y = 0 then 1 else 0 end as falsePosPred,
               case when p10 = 0 and y = 1 then 1 else 0 end as falseNegPred,
               p10 = y as match from pred)"""


def _knn_residuals(spark, sf_dir):
    neigh, test = _neighbours(spark, sf_dir)
    pred = M.knn_predictions(neigh, KS).select(F.col("q_key").alias("loan"), F.col("pred_10").alias("Y_hat"))
    joined = test.select("loan", LABEL).join(pred, "loan")
    return M.residual_table(joined, LABEL)


@query("residuals", _KNN_RES_SQL + f"""
select loan, {LABEL}, Y_hat, falsePosPred, falseNegPred, match from res""")
def residuals(spark, sf_dir):
    """K8: residual table of the 10-NN predictions on the test loans."""
    return _knn_residuals(spark, sf_dir).select("loan", LABEL, "Y_hat", "falsePosPred", "falseNegPred", "match")


@query("result_shares", _KNN_RES_SQL + f"""
select round(avg(case when match then 1.0 else 0.0 end), 6) as pct_match,
       round(avg(case when {LABEL} = 1 and Y_hat = 1 then 1.0 else 0.0 end), 6) as pct_true_pos,
       round(avg(falsePosPred), 6) as pct_false_pos, round(avg(falseNegPred), 6) as pct_false_neg from res""")
def result_shares(spark, sf_dir):
    """K9: shares of matches / true positives / false positives / false negatives."""
    s = M.result_shares(_knn_residuals(spark, sf_dir), LABEL)
    return s.select(*[rnd(c, 6).alias(c) for c in ("pct_match", "pct_true_pos", "pct_false_pos", "pct_false_neg")])


@query("confusion", _KNN_RES_SQL + f"""
select count(*) as n, count(case when match then 1 end) as matches,
       count(case when {LABEL} = 1 and Y_hat = 1 then 1 end) as tp,
       count(case when {LABEL} = 0 and Y_hat = 0 then 1 end) as tn,
       count(case when {LABEL} = 0 and Y_hat = 1 then 1 end) as fp,
       count(case when {LABEL} = 1 and Y_hat = 0 then 1 end) as fn from res""")
def confusion(spark, sf_dir):
    """Confusion counts."""
    return M.confusion_counts(_knn_residuals(spark, sf_dir), LABEL)


@query("prediction_export", _KNN_RES_SQL + f"""
select loan, {LABEL} as test_y, Y_hat as predictedValue from res""")
def prediction_export(spark, sf_dir):
    """Loan, truth and prediction of the last k."""
    return M.prediction_export(_knn_residuals(spark, sf_dir), "loan", LABEL)
