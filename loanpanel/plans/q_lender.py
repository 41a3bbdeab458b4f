"""Lender / region queries (F1-F5, F8, F10, J1, L16-L18) on the bound tables.

Month-grained statistics use one row per loan and month (orders joined to
their customer: servicer = market segment, MSA = nation); region-level
statistics use one row per loan.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loanpanel.functions.exprs import month_bucket, rnd, t_pvalue_sql
from loanpanel.operators import lender as L
from loanpanel.plans import driver_tables as T
from loanpanel.plans.registry import query


def _month_rows(spark, sf_dir, loans=T.loans):
    lm = T.panel(spark, sf_dir).join(loans(spark, sf_dir), "loan", "inner")
    return lm.select(F.col("servicer").alias("servicerName"), F.col("msa").alias("MSA"),
                     month_bucket("month").alias("Month"), F.col("score").alias("creditScore"),
                     "loan")


def _loan_rows(spark, sf_dir, loans=T.loans):
    """One row per loan with its first reporting month (the first payment date)."""
    first = T.panel(spark, sf_dir).groupBy("loan").agg(F.min("month").alias("firstPaymentDate"))
    lo = loans(spark, sf_dir).join(first, "loan", "inner")
    return lo.select("loan", F.col("servicer").alias("servicerName"), F.col("msa").alias("MSA"),
                     F.col("score").alias("creditScore"), "firstPaymentDate")


_MONTH_ROWS_SQL = T.with_ctes("loan_months") + """,
b as (select servicer as servicerName, msa as MSA, strftime(month, '%Y-%m') as Month,
             score as creditScore, loan from loan_months)"""

_LOAN_ROWS_SQL = T.with_ctes("panel", "loans") + """,
b as (select l.loan, l.servicer as servicerName, l.msa as MSA, l.score as creditScore, f.firstPaymentDate
      from loans l join (select loan, min(month) as firstPaymentDate from panel group by loan) f using (loan))"""


@query("score_trend", _MONTH_ROWS_SQL + """
select servicerName, Month, count(creditScore) as creditScore_count,
       round(avg(creditScore), 6) as creditScore_mean, round(stddev_samp(creditScore), 6) as creditScore_std,
       round(var_samp(creditScore), 6) as creditScore_var, min(creditScore) as creditScore_min,
       max(creditScore) as creditScore_max,
       round(quantile_cont(creditScore, 0.25), 4) as pctl_25, round(quantile_cont(creditScore, 0.75), 4) as pctl_75,
       round((quantile_cont(creditScore, 0.75) - quantile_cont(creditScore, 0.25)) / nullif(avg(creditScore), 0), 6)
         as Coef_var
from b group by servicerName, Month""")
def score_trend(spark, sf_dir):
    t = L.credit_quality_trend(_month_rows(spark, sf_dir))
    return t.select("servicerName", "Month", "creditScore_count",
                    rnd("creditScore_mean", 6).alias("creditScore_mean"),
                    rnd("creditScore_std", 6).alias("creditScore_std"),
                    rnd("creditScore_var", 6).alias("creditScore_var"),
                    "creditScore_min", "creditScore_max",
                    rnd("pctl_25", 4).alias("pctl_25"), rnd("pctl_75", 4).alias("pctl_75"),
                    rnd("Coef_var", 6).alias("Coef_var"))


@query("msa_spread", _LOAN_ROWS_SQL + """
select MSA, round(avg(creditScore), 6) as MSACreditScore_mean, round(stddev_samp(creditScore), 6) as MSACreditScore_std,
       max(creditScore) as MSACreditScore_max, min(creditScore) as MSACreditScore_min,
       round(var_samp(creditScore), 6) as MSACreditScore_var
from b where MSA is not null group by MSA""")
def msa_spread(spark, sf_dir):
    s = L.msa_score_spread(_loan_rows(spark, sf_dir))
    return s.select("MSA", rnd("MSACreditScore_mean", 6).alias("MSACreditScore_mean"),
                    rnd("MSACreditScore_std", 6).alias("MSACreditScore_std"),
                    "MSACreditScore_max", "MSACreditScore_min",
                    rnd("MSACreditScore_var", 6).alias("MSACreditScore_var"))


@query("lender_msa", _LOAN_ROWS_SQL + """,
m as (select MSA, avg(creditScore) as mm, stddev_samp(creditScore) as ms from b where MSA is not null group by MSA)
select servicerName, MSA, round(avg(creditScore), 6) as LenderMSACreditScore_mean,
       count(creditScore) as totalMortgages, round(any_value(m.mm), 6) as MSACreditScore_mean,
       round(any_value(m.ms), 6) as MSACreditScore_std, 0 as lenderAvg_zScore,
       round((avg(creditScore) - any_value(m.mm)) / nullif(any_value(m.ms), 0), 6) as zScore
from b join m using (MSA) where servicerName is not null group by servicerName, MSA""")
def lender_msa(spark, sf_dir):
    t = L.lender_performance_by_msa(_loan_rows(spark, sf_dir))
    return t.select("servicerName", "MSA", rnd("LenderMSACreditScore_mean", 6).alias("LenderMSACreditScore_mean"),
                    "totalMortgages", rnd("MSACreditScore_mean", 6).alias("MSACreditScore_mean"),
                    rnd("MSACreditScore_std", 6).alias("MSACreditScore_std"), "lenderAvg_zScore",
                    rnd("zScore", 6).alias("zScore"))


_OUTLIER_SQL = _LOAN_ROWS_SQL + """,
m as (select MSA, avg(creditScore) as mm, stddev_samp(creditScore) as ms from b where MSA is not null group by MSA),
o as (select b.*, m.mm, m.ms,
             case when creditScore >= mm + ms * 3.0 then 1 else 0 end as creditScoreOutlier_over,
             case when creditScore <= mm - ms * 3.0 then 1 else 0 end as creditScoreOutlier_under
      from b left join m using (MSA))"""


@query("score_outliers", _OUTLIER_SQL + """
select loan, MSA, creditScore, round(mm, 6) as MSACreditScore_mean, round(ms, 6) as MSACreditScore_std,
       creditScoreOutlier_over, creditScoreOutlier_under, cast(year(firstPaymentDate) as int) as year
from o""")
def score_outliers(spark, sf_dir):
    o = L.score_outliers(_loan_rows(spark, sf_dir))
    return o.select("loan", "MSA", "creditScore", rnd("MSACreditScore_mean", 6).alias("MSACreditScore_mean"),
                    rnd("MSACreditScore_std", 6).alias("MSACreditScore_std"),
                    "creditScoreOutlier_over", "creditScoreOutlier_under", "year")


@query("outlier_shares", _OUTLIER_SQL + """
select round(avg(creditScoreOutlier_over), 6) as share_over, round(avg(creditScoreOutlier_under), 6) as share_under
from o""")
def outlier_shares(spark, sf_dir):
    s = L.outlier_shares(L.score_outliers(_loan_rows(spark, sf_dir)))
    return s.select(rnd("share_over", 6).alias("share_over"), rnd("share_under", 6).alias("share_under"))


_TAIL_OUTLIER_SQL = _OUTLIER_SQL.replace(T.LOANS_SQL, T.TAIL_LOANS_SQL)


@query("score_outliers_tails", _TAIL_OUTLIER_SQL + """
select loan, MSA, creditScore, creditScoreOutlier_over, creditScoreOutlier_under from o
where creditScoreOutlier_over + creditScoreOutlier_under > 0""")
def score_outliers_tails(spark, sf_dir):
    """L17 where some loans are far from their region's scores: the flagged ones."""
    o = L.score_outliers(_loan_rows(spark, sf_dir, T.tail_loans))
    return (o.where(F.col("creditScoreOutlier_over") + F.col("creditScoreOutlier_under") > 0)
             .select("loan", "MSA", "creditScore", "creditScoreOutlier_over", "creditScoreOutlier_under"))


@query("outlier_shares_tails", _TAIL_OUTLIER_SQL + """
select round(avg(creditScoreOutlier_over), 6) as share_over, round(avg(creditScoreOutlier_under), 6) as share_under
from o""")
def outlier_shares_tails(spark, sf_dir):
    """F10 on the same loans: both shares above 0."""
    s = L.outlier_shares(L.score_outliers(_loan_rows(spark, sf_dir, T.tail_loans)))
    return s.select(rnd("share_over", 6).alias("share_over"), rnd("share_under", 6).alias("share_under"))


# The oracle states the leave-one-out mean as a correlated subquery over the
# rows (the literal per-cell rescan), independent of the Spark window algebra.
_LOO_SQL = _MONTH_ROWS_SQL + """,
b2 as (select * from b where MSA is not null and Month is not null and creditScore is not null
          and servicerName is distinct from 'Other servicers'),
cells as (select servicerName, MSA, Month, count(creditScore) as n, avg(creditScore) as mean,
                 stddev_samp(creditScore) as sd
          from b2 where servicerName is not null group by servicerName, MSA, Month),
loo as (select c.*,
               (select count(*) from b2 where b2.MSA = c.MSA and b2.Month = c.Month
                   and b2.servicerName is distinct from c.servicerName) as pop_n,
               (select avg(creditScore) from b2 where b2.MSA = c.MSA and b2.Month = c.Month
                   and b2.servicerName is distinct from c.servicerName) as pop_mean
        from cells c)"""


@query("leave_one_out", _LOO_SQL + """
select servicerName, MSA, Month, n, round(mean, 6) as mean, round(sd, 6) as sd, pop_n, round(pop_mean, 6) as pop_mean
from loo where pop_n > 0""")
def leave_one_out(spark, sf_dir):
    c = L.leave_one_out_means(_month_rows(spark, sf_dir))
    return c.select("servicerName", "MSA", "Month", "n", rnd("mean", 6).alias("mean"), rnd("sd", 6).alias("sd"),
                    "pop_n", rnd("pop_mean", 6).alias("pop_mean"))


@query("leave_one_out_catch_all", _LOO_SQL.replace(T.LOANS_SQL, T.TAIL_LOANS_SQL) + """
select servicerName, MSA, Month, n, round(mean, 6) as mean, round(sd, 6) as sd, pop_n, round(pop_mean, 6) as pop_mean
from loo where pop_n > 0""")
def leave_one_out_catch_all(spark, sf_dir):
    """F8 + B12 where every ninth loan belongs to the catch-all servicer, which is neither a cell nor in a mean."""
    c = L.leave_one_out_means(_month_rows(spark, sf_dir, T.tail_loans))
    return c.select("servicerName", "MSA", "Month", "n", rnd("mean", 6).alias("mean"), rnd("sd", 6).alias("sd"),
                    "pop_n", rnd("pop_mean", 6).alias("pop_mean"))


@query("adverse_selection_ttest", _LOO_SQL + """,
tt as (select *, case when sd > 0 then (mean - pop_mean) / (sd / sqrt(n)) end as t, n - 1 as dof
       from loo where pop_n > 0 and n >= 2 and not (sd = 0 and mean = pop_mean))
select servicerName, MSA, Month, n, round(t, 6) as t,
       round(case when sd > 0 then """ + t_pvalue_sql("t", "dof") + """ else 0.0 end, 6) as p_value, dof
from tt""")
def adverse_selection_ttest(spark, sf_dir):
    t = L.adverse_selection_ttest(_month_rows(spark, sf_dir))
    return t.select("servicerName", "MSA", "Month", "n", rnd("t", 6).alias("t"),
                    rnd("p_value", 6).alias("p_value"), "dof")
