"""Lender and regional score statistics.

Every statistic is a partial aggregate (count/sum/moments), so a servicer
holding a third of all loans is combined map-side before the shuffle;
exact quartiles are read by rank from segments of the order, so no task
holds a group's values.  Region statistics
are joined back onto loans with an equi-join; AQE turns it into a
broadcast when the runtime size of the region table is under the
broadcast threshold, otherwise it stays a shuffle join.  Leave-one-out
means use a window over the pre-aggregated (region, month, servicer)
cells, so the window only sees one row per servicer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.functions.exprs import safe_div, two_sided_t_pvalue
from loanpanel.functions.segments import grouped_quantiles

OTHER_SERVICERS = "Other servicers"  # fixed value: the catch-all servicer name


def exclude_servicer(df: DataFrame, servicer: str = "servicerName",
                     name: str = OTHER_SERVICERS) -> DataFrame:
    """Drop the catch-all servicer; NULL names are kept (pandas ``!=``)."""
    return df.where(~F.col(servicer).eqNullSafe(F.lit(name)))


def credit_quality_trend(df: DataFrame, group=("servicerName", "Month"),
                         score: str = "creditScore") -> DataFrame:
    """L18 (F1 + F4 + F5): count, mean, std, var, min, max, p25, p75 and
    ``Coef_var`` = (p75 - p25) / mean per group: one aggregate, and the quartiles by rank."""
    s = F.col(score)
    base = df.where(F.col(score).isNotNull())
    out = base.groupBy(*group).agg(
        F.count(s).alias(f"{score}_count"),
        F.avg(s).alias(f"{score}_mean"),
        F.stddev_samp(s).alias(f"{score}_std"),
        F.var_samp(s).alias(f"{score}_var"),
        F.min(s).alias(f"{score}_min"),
        F.max(s).alias(f"{score}_max"),
    )
    quartiles = grouped_quantiles(base, group, score, {"pctl_25": 0.25, "pctl_75": 0.75})
    same = [F.col(f"a.`{g}`").eqNullSafe(F.col(f"q.`{g}`")) for g in group]
    out = out.alias("a").join(quartiles.alias("q"), same, "left").select("a.*", "q.pctl_25", "q.pctl_75")
    return out.withColumn("Coef_var", safe_div(F.col("pctl_75") - F.col("pctl_25"), f"{score}_mean"))


def msa_score_spread(df: DataFrame, msa: str = "MSA", score: str = "creditScore",
                     prefix: str = "MSACreditScore") -> DataFrame:
    """F2: mean, std, max, min, var of scores per region (NULL regions dropped)."""
    s = F.col(score)
    return df.where(F.col(msa).isNotNull()).groupBy(msa).agg(
        F.avg(s).alias(f"{prefix}_mean"),
        F.stddev_samp(s).alias(f"{prefix}_std"),
        F.max(s).alias(f"{prefix}_max"),
        F.min(s).alias(f"{prefix}_min"),
        F.var_samp(s).alias(f"{prefix}_var"),
    )


def lender_performance_by_msa(df: DataFrame, servicer: str = "servicerName", msa: str = "MSA",
                              score: str = "creditScore") -> DataFrame:
    """L16 (F3 + F2 + E4): lender mean and count per region, region stats
    joined on, ``zScore`` = (lender mean - region mean) / region std and the
    constant ``lenderAvg_zScore`` = 0 the source carries."""
    base = df.where(F.col(servicer).isNotNull() & F.col(msa).isNotNull())
    lender = base.groupBy(servicer, msa).agg(
        F.avg(score).alias("LenderMSACreditScore_mean"),
        F.count(score).alias("totalMortgages"))
    out = lender.join(msa_score_spread(df, msa, score), msa, "left")
    return (out.withColumn("lenderAvg_zScore", F.lit(0))
               .withColumn("zScore", safe_div(F.col("LenderMSACreditScore_mean")
                                              - F.col("MSACreditScore_mean"), "MSACreditScore_std")))


def score_outliers(df: DataFrame, msa: str = "MSA", score: str = "creditScore",
                   date: str | None = "firstPaymentDate", sigmas: float = 3.0) -> DataFrame:
    """Flag loans at least ``sigmas`` region standard deviations above
    (``creditScoreOutlier_over``) or below (``_under``) the region mean; adds
    ``year`` of ``date``.  Loans with a NULL region keep NULL statistics."""
    stats = msa_score_spread(df, msa, score)
    out = df.join(stats, msa, "left")
    mean, std = F.col("MSACreditScore_mean"), F.col("MSACreditScore_std")
    out = (out.withColumn("creditScoreOutlier_over",
                          F.when(F.col(score) >= mean + std * sigmas, 1).otherwise(0))
              .withColumn("creditScoreOutlier_under",
                          F.when(F.col(score) <= mean - std * sigmas, 1).otherwise(0)))
    if date:
        out = out.withColumn("year", F.year(date))
    return out


def outlier_shares(flagged: DataFrame) -> DataFrame:
    """share of over- and under-outliers."""
    return flagged.agg(F.avg("creditScoreOutlier_over").alias("share_over"),
                       F.avg("creditScoreOutlier_under").alias("share_under"))


def leave_one_out_means(df: DataFrame, servicer: str = "servicerName", msa: str = "MSA",
                        period: str = "Month", score: str = "creditScore",
                        exclude: str | None = OTHER_SERVICERS) -> DataFrame:
    """F8: per servicer x region x period cell, the sample statistics and the
    mean score of all *other* servicers in the same region and period.

    Cells are aggregated first; a window over the (region, period) cells
    subtracts each cell from the region-period totals, replacing the
    source's per-cell rescans.  Cells without other servicers are dropped.
    Rows of the catch-all servicer ``exclude`` are removed first (B12).
    """
    if exclude is not None:
        df = exclude_servicer(df, servicer, exclude)
    base = df.where(F.col(msa).isNotNull() & F.col(period).isNotNull() & F.col(score).isNotNull())
    s = F.col(score).cast("double")
    cells = base.groupBy(msa, period, servicer).agg(
        F.count(s).alias("n"),
        F.sum(s).alias("sx"),
        F.avg(s).alias("mean"),
        F.stddev_samp(s).alias("sd"))
    w = Window.partitionBy(msa, period)
    cells = (cells.withColumn("pop_n", F.sum("n").over(w) - F.col("n"))
                  .withColumn("pop_sum", F.sum("sx").over(w) - F.col("sx")))
    cells = cells.withColumn("pop_mean", safe_div("pop_sum", "pop_n"))
    return cells.where(F.col(servicer).isNotNull() & (F.col("pop_n") > 0)).drop("sx", "pop_sum")


def adverse_selection_ttest(df: DataFrame, servicer: str = "servicerName", msa: str = "MSA",
                            period: str = "Month", score: str = "creditScore",
                            exclude: str | None = OTHER_SERVICERS) -> DataFrame:
    """One-sample t-test of a servicer's scores in a region and period
    against the leave-one-out mean of the other servicers (F8).

    ``t = (mean - pop_mean) / (sd / sqrt(n))`` with ``n - 1`` degrees of
    freedom and a closed-form two-sided p-value.  Cells where the test is
    undefined (n < 2, or zero spread with equal means) are dropped; a
    zero-spread cell with a different mean keeps ``t`` NULL and ``p`` 0.
    """
    c = leave_one_out_means(df, servicer, msa, period, score, exclude).where(F.col("n") >= 2)
    diff = F.col("mean") - F.col("pop_mean")
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    c = c.where(~((F.col("sd") == 0) & (diff == 0)))
    t = F.when(F.col("sd") > 0, diff / se)
    p = F.when(F.col("sd") > 0, two_sided_t_pvalue(t, F.col("n") - 1)).otherwise(F.lit(0.0))
    return c.withColumn("t", t).withColumn("p_value", p).withColumn("dof", (F.col("n") - 1).cast("long"))
