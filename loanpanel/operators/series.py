"""Regional time series and unit-root tests.

The series are built by one ``groupBy(region, period)`` with partial
aggregation, so their size is regions x periods x statistics no matter how
many loans feed them; windows and the per-series test then run on those
small series.  The Dickey-Fuller regression without lags is a set of
``regr_*`` aggregates; the augmented test with AIC lag choice needs a
least-squares fit per candidate lag and runs as a grouped-map over the
(small) series with numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.functions.exprs import NCDF_B as _AS_B  # noqa: F401  (re-exported for the SQL twin)
from loanpanel.functions.exprs import NCDF_P as _AS_P  # noqa: F401
from loanpanel.functions.exprs import normal_upper_tail

# MacKinnon (2010) response-surface coefficients for the
# Dickey-Fuller critical values, constant-only regression, one variable:
# crit(T) = b_inf + b1/T + b2/T^2 + b3/T^3.
DF_CRIT_CONSTANT = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
# MacKinnon (1994) approximate p-value polynomials for the
# constant-only Dickey-Fuller statistic, one variable (lowest power first).
DF_P_TAU_MAX = 2.74
DF_P_TAU_MIN = -18.83
DF_P_TAU_STAR = -1.61
DF_P_SMALL = (2.1659, 1.4412, 0.038269)
DF_P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)

MIN_SERIES = 10


def msa_series(df: DataFrame, stats: Iterable[str], region: str = "MSA",
               period: str = "firstPaymentDate") -> DataFrame:
    """mean of each statistic per region and period, all statistics in
    one aggregate, then unpivoted to (region, stat, period, value)."""
    stats = list(stats)
    base = df.where(F.col(region).isNotNull() & F.col(period).isNotNull())
    wide = base.groupBy(region, period).agg(*[F.avg(F.col(s).cast("double")).alias(s) for s in stats])
    return wide.unpivot([region, period], stats, "stat", "value")


def rolling_stats(series: DataFrame, region: str = "MSA", period: str = "firstPaymentDate",
                  window: int = 3) -> DataFrame:
    """Rolling mean and sample std over ``window`` periods of each series,
    NULL until the frame is full."""
    w = Window.partitionBy(region, "stat").orderBy(period).rowsBetween(-(window - 1), 0)
    full = F.count("value").over(w) == window
    return (series.withColumn("rollMean", F.when(full, F.avg("value").over(w)))
                  .withColumn("rollStd", F.when(full, F.stddev_samp("value").over(w))))


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF (A&S 26.2.17, |error| < 7.5e-8)."""
    upper = normal_upper_tail(x)
    return F.when(x >= 0, 1.0 - upper).otherwise(upper)


def _poly(coefs, x: Column) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefs):
        out = out * x + c
    return out


def df_pvalue(tau: Column) -> Column:
    """Approximate p-value of the constant-only Dickey-Fuller statistic."""
    return (F.when(tau.isNull(), F.lit(None).cast("double"))
             .when(tau > DF_P_TAU_MAX, 1.0).when(tau < DF_P_TAU_MIN, 0.0)
             .when(tau <= DF_P_TAU_STAR, normal_cdf(_poly(DF_P_SMALL, tau)))
             .otherwise(normal_cdf(_poly(DF_P_LARGE, tau))))


def df_critical(nobs: Column, level: str = "5%") -> Column:
    b = DF_CRIT_CONSTANT[level]
    n = nobs.cast("double")
    return F.lit(b[0]) + b[1] / n + b[2] / (n * n) + b[3] / (n * n * n)


def dickey_fuller(series: DataFrame, region: str = "MSA", period: str = "firstPaymentDate",
                  alpha: float = 0.05, min_obs: int = MIN_SERIES) -> DataFrame:
    """J2 without augmentation lags: regress the change on the lagged level
    (with a constant) per series; tau = slope / se, MacKinnon p-value, 5 %
    critical value; ``stationary`` when p < ``alpha``.  Series shorter than
    ``min_obs`` periods are skipped."""
    w = Window.partitionBy(region, "stat").orderBy(period)
    lagged = series.withColumn("_ylag", F.lag("value").over(w)) \
                   .withColumn("_dy", F.col("value") - F.col("_ylag"))
    g = lagged.groupBy(region, "stat").agg(
        F.count("value").alias("n_periods"),
        F.regr_count("_dy", "_ylag").alias("nobs"),
        F.regr_sxx("_dy", "_ylag").alias("_sxx"),
        F.regr_sxy("_dy", "_ylag").alias("_sxy"),
        F.regr_syy("_dy", "_ylag").alias("_syy"))
    g = g.where(F.col("n_periods") >= min_obs)
    gamma = F.col("_sxy") / F.nullif(F.col("_sxx"), F.lit(0.0))
    rss = F.col("_syy") - gamma * F.col("_sxy")
    se = F.sqrt(rss / (F.col("nobs") - 2) / F.col("_sxx"))
    tau = F.when(se > 0, gamma / se)
    out = g.withColumn("gamma", gamma).withColumn("adf_stat", tau)
    out = out.withColumn("p_value", df_pvalue(F.col("adf_stat"))) \
             .withColumn("crit_5pct", df_critical(F.col("nobs")))
    out = out.withColumn("stationary", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
    return out.drop("_sxx", "_sxy", "_syy")


# ---------------------------------------------------------------------------
# Augmented test with AIC lag choice (grouped map over the small series)
# ---------------------------------------------------------------------------

ADF_SCHEMA = ("stat string, n_periods long, nobs long, used_lag int, adf_stat double, "
              "p_value double, crit_5pct double, stationary boolean")


def _np_pvalue(tau: float) -> float:
    if tau is None or math.isnan(tau):
        return float("nan")
    if tau > DF_P_TAU_MAX:
        return 1.0
    if tau < DF_P_TAU_MIN:
        return 0.0
    coefs = DF_P_SMALL if tau <= DF_P_TAU_STAR else DF_P_LARGE
    x = sum(c * tau ** i for i, c in enumerate(coefs))
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _np_crit(nobs: int) -> float:
    b = DF_CRIT_CONSTANT["5%"]
    return b[0] + b[1] / nobs + b[2] / nobs ** 2 + b[3] / nobs ** 3


def adf_autolag_one(values, max_lag: int | None = None):
    """Augmented Dickey-Fuller with a constant, lag chosen by AIC over a
    common sample, then refit on all usable rows.  Returns
    (nobs, used_lag, tau) or None when the series is too short or singular."""
    import numpy as np
    x = np.asarray(values, dtype=float)
    n = len(x)
    if max_lag is None:
        max_lag = int(math.ceil(12.0 * (n / 100.0) ** 0.25))
    max_lag = min(n // 2 - 2, max_lag)
    if max_lag < 0:
        return None
    dx = np.diff(x)

    def design(lag: int, start: int):
        rows = range(start, len(dx))
        y = dx[start:]
        cols = [x[start:len(dx)]]                      # lagged level x_{t-1} for dx_t
        for j in range(1, lag + 1):
            cols.append(dx[start - j:len(dx) - j])
        cols.append(np.ones(len(rows)))
        return y, np.column_stack(cols)

    def fit(y, X):
        beta, _, rank, _ = np.linalg.lstsq(X, y, rcond=None)
        if rank < X.shape[1]:
            return None
        resid = y - X @ beta
        ssr = float(resid @ resid)
        k = X.shape[1]
        nob = len(y)
        return beta, ssr, k, nob

    best = None
    for lag in range(0, max_lag + 1):
        y, X = design(lag, max_lag)
        if len(y) <= X.shape[1]:
            continue
        f = fit(y, X)
        if f is None:
            continue
        _, ssr, k, nob = f
        if ssr <= 0:
            continue
        llf = -nob / 2.0 * (math.log(2 * math.pi) + math.log(ssr / nob) + 1)
        aic = -2 * llf + 2 * k
        if best is None or aic < best[0]:
            best = (aic, lag)
    if best is None:
        return None
    lag = best[1]
    y, X = design(lag, lag)
    f = fit(y, X)
    if f is None or len(y) <= X.shape[1]:
        return None
    beta, ssr, k, nob = f
    sigma2 = ssr / (nob - k)
    cov = sigma2 * np.linalg.inv(X.T @ X)
    if cov[0, 0] <= 0:
        return None
    return nob, lag, float(beta[0] / math.sqrt(cov[0, 0]))


def adf_autolag(series: DataFrame, region: str = "MSA", period: str = "firstPaymentDate",
                alpha: float = 0.05, min_obs: int = MIN_SERIES) -> DataFrame:
    """J2 with AIC lag choice, one grouped-map call per (region, stat) series."""
    import pandas as pd

    region_type = dict(series.dtypes)[region]
    schema = f"{region} {region_type}, " + ADF_SCHEMA

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(period)
        vals = pdf["value"].dropna().to_numpy()
        res = adf_autolag_one(vals) if len(vals) >= min_obs else None
        if res is None:
            return pd.DataFrame(columns=[region, "stat", "n_periods", "nobs", "used_lag", "adf_stat",
                                         "p_value", "crit_5pct", "stationary"])
        nobs, lag, tau = res
        p = _np_pvalue(tau)
        return pd.DataFrame([{
            region: pdf[region].iloc[0], "stat": pdf["stat"].iloc[0], "n_periods": len(vals),
            "nobs": nobs, "used_lag": lag, "adf_stat": tau, "p_value": p,
            "crit_5pct": _np_crit(nobs), "stationary": bool(p < alpha)}])

    return series.select(region, "stat", period, "value").groupBy(region, "stat").applyInPandas(run, schema)
