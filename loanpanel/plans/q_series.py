"""Regional series queries (F6, G9, J2): mean statistic per nation and month
over the loan-month rows, rolling stats, Dickey-Fuller tests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loanpanel.functions.exprs import rnd
from loanpanel.operators import series as S
from loanpanel.plans import driver_tables as T
from loanpanel.plans.registry import query

STATS = ("upb", "status", "score", "balance")
MONEY = ("upb", "balance")   # averaged in whole cents: integer sums are exact in every engine


def _series(spark, sf_dir):
    lm = T.loan_months(spark, sf_dir).select(
        F.col("msa").alias("MSA"), "month",
        *[F.round(F.col(s) * 100).cast("long").alias(s) if s in MONEY else F.col(s) for s in STATS])
    series = S.msa_series(lm, STATS, "MSA", "month")
    return series.withColumn("value", F.when(F.col("stat").isin(*MONEY), F.col("value") / 100.0)
                             .otherwise(F.col("value")))


def _avg_sql(s: str) -> str:
    if s in MONEY:
        return f"avg(cast(round({s} * 100) as bigint)) / 100.0 as {s}"
    return f"avg(cast({s} as double)) as {s}"


_SERIES_SQL = T.with_ctes("loan_months") + """,
w as (select msa as MSA, month, """ + ", ".join(_avg_sql(s) for s in STATS) + """
      from loan_months where msa is not null and month is not null group by msa, month),
s as (""" + "\nunion all\n".join(f"select MSA, month, '{s}' as stat, {s} as value from w" for s in STATS) + ")"


@query("msa_series", _SERIES_SQL + """
select MSA, month, stat, round(value, 6) as value from s""")
def msa_series(spark, sf_dir):
    return _series(spark, sf_dir).select("MSA", "month", "stat", rnd("value", 6).alias("value"))


@query("rolling_stats", _SERIES_SQL + """
select MSA, month, stat, round(value, 6) as value,
       round(case when count(value) over w = 3 then avg(value) over w end, 6) as rollMean,
       round(case when count(value) over w = 3 then stddev_samp(value) over w end, 6) as rollStd
from s window w as (partition by MSA, stat order by month rows between 2 preceding and current row)""")
def rolling_stats(spark, sf_dir):
    r = S.rolling_stats(_series(spark, sf_dir), "MSA", "month", 3)
    return r.select("MSA", "month", "stat", rnd("value", 6).alias("value"),
                    rnd("rollMean", 6).alias("rollMean"), rnd("rollStd", 6).alias("rollStd"))


def _poly_sql(coefs, x: str) -> str:
    out = "0.0"
    for c in reversed(coefs):
        out = f"(({out}) * {x} + {c!r})"
    return out


def _ncdf_sql(x: str) -> str:
    z = f"abs({x})"
    t = f"(1.0 / (1.0 + {S._AS_P!r} * {z}))"
    poly = "0.0"
    for b in reversed(S._AS_B):
        poly = f"(({poly}) + {b!r}) * {t}"
    upper = f"(exp(-{z} * {z} / 2.0) / {math.sqrt(2 * math.pi)!r} * {poly})"
    return f"(case when {x} >= 0 then 1.0 - {upper} else {upper} end)"


def _df_p_sql(tau: str) -> str:
    return (f"case when {tau} is null then null when {tau} > {S.DF_P_TAU_MAX} then 1.0 "
            f"when {tau} < {S.DF_P_TAU_MIN} then 0.0 "
            f"when {tau} <= {S.DF_P_TAU_STAR} then {_ncdf_sql(_poly_sql(S.DF_P_SMALL, tau))} "
            f"else {_ncdf_sql(_poly_sql(S.DF_P_LARGE, tau))} end")


_B = S.DF_CRIT_CONSTANT["5%"]


@query("unit_root", _SERIES_SQL + """,
l as (select *, value - lag(value) over (partition by MSA, stat order by month) as dy,
             lag(value) over (partition by MSA, stat order by month) as ylag from s),
g as (select MSA, stat, count(value) as n_periods, cast(regr_count(dy, ylag) as bigint) as nobs,
             regr_sxx(dy, ylag) as sxx, regr_sxy(dy, ylag) as sxy, regr_syy(dy, ylag) as syy
      from l group by MSA, stat having count(value) >= 10),
t as (select *, sxy / nullif(sxx, 0.0) as gamma,
             case when sqrt((syy - sxy / nullif(sxx, 0.0) * sxy) / (nobs - 2) / sxx) > 0
                  then (sxy / nullif(sxx, 0.0)) / sqrt((syy - sxy / nullif(sxx, 0.0) * sxy) / (nobs - 2) / sxx)
             end as tau from g),
p as (select *, """ + _df_p_sql("tau") + f""" as p_value,
             {_B[0]!r} + {_B[1]!r} / nobs + {_B[2]!r} / (nobs * nobs) + {_B[3]!r} / (nobs * nobs * nobs) as crit
      from t)
select MSA, stat, n_periods, nobs, round(gamma, 6) as gamma, round(tau, 6) as adf_stat,
       round(p_value, 6) as p_value, round(crit, 6) as crit_5pct, coalesce(p_value < 0.05, false) as stationary
from p""")
def unit_root(spark, sf_dir):
    d = S.dickey_fuller(_series(spark, sf_dir), "MSA", "month")
    return d.select("MSA", "stat", "n_periods", "nobs", rnd("gamma", 6).alias("gamma"),
                    rnd("adf_stat", 6).alias("adf_stat"), rnd("p_value", 6).alias("p_value"),
                    rnd("crit_5pct", 6).alias("crit_5pct"), "stationary")


@query("unit_root_aic")
def unit_root_aic(spark, sf_dir):
    """J2 with AIC-chosen augmentation lags (grouped map; rows-only check)."""
    return S.adf_autolag(_series(spark, sf_dir), "MSA", "month")
