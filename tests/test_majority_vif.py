"""C9 by majority candidates; J3/J4 on many columns, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanpanel.operators import quality as Q
from loanpanel.operators import select as SEL


def test_majority_values_against_counts(spark):
    n = 20_000
    df = spark.range(n).select(
        F.when(F.col("id") < n // 2, "x").otherwise(F.col("id").cast("string")).alias("half"),
        F.when(F.col("id") <= n // 2, "x").otherwise(F.col("id").cast("string")).alias("over half"),
        F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(-1).alias("at.bound"),        # 99 % exactly
        F.when(F.col("id") % 101 == 0, F.col("id")).otherwise(-1).alias("above"),
        F.when(F.col("id") % 4 == 0, None).otherwise(5.5).alias("gaps"),
        (F.col("id") % 2).alias("tie"), F.col("id").alias("unique"),
        F.lit(None).cast("date").alias("void")).repartition(16, "unique")
    got = {r["column_name"]: (r["n_nonnull"], r["majority_n"], r["homogeneous"]) for r in Q.majority_values(df).collect()}
    pdf = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).toPandas()
    for c in df.columns:
        counts = pdf[c].value_counts()
        total, top = int(counts.sum()), int(counts.max()) if len(counts) else 0
        over = 2 * top > total
        assert got[c] == (total, top if over else None, bool(over and top / total > 0.99)), c
    assert Q.remove_homogeneity(df.select("above", "gaps", "tie")).columns == ["tie"]
    assert {r["n_nonnull"] for r in Q.majority_values(df.limit(0)).collect()} == {0}
    with pytest.raises(ValueError):
        Q.majority_values(df, thresh=0.4)


def brute_vif(x):
    out = []
    for i in range(x.shape[1]):
        rest = np.delete(x, i, axis=1)
        left = x[:, i] - rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        own = x[:, i] @ x[:, i]
        out.append(np.inf if left @ left <= 1e-12 * own else own / (left @ left))
    return np.array(out)


def brute_elimination(x, thresh, drop_infinite_first):
    keep, dropped = list(range(x.shape[1])), []
    if drop_infinite_first:
        v = brute_vif(x)
        dropped = [(0, i) for i in keep if np.isinf(v[i])]
        keep = [i for i in keep if not np.isinf(v[i])]
    rnd = 1
    while len(keep) > 1:
        v = brute_vif(x[:, keep])
        m = int(np.argmax(v))
        if not v[m] > thresh:
            break
        dropped.append((rnd, keep.pop(m)))
        rnd += 1
    return keep, dropped


@pytest.mark.parametrize("tied,strict,thresh", [(False, False, 20.0), (False, True, 2.0), (True, True, 2.0), (True, False, 20.0)])
def test_vif_elimination_equals_regressions(spark, tied, strict, thresh):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 6)) * [1, 1e4, 1e-3, 1, 50, 1]
    x[:, 3] = x[:, 0] + 0.1 * rng.normal(size=400)
    x[:, 4] = x[:, 1] * 0.01 + 30 * rng.normal(size=400)
    if tied:
        x = np.column_stack([x, x[:, 2] * 7 - x[:, 5] * 0.5])
    cols = [f"c.{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(5)
    kept, log, final = SEL.vif_elimination(df, cols, thresh, strict)
    keep, dropped = brute_elimination(x, thresh, strict)
    assert kept == [cols[i] for i in keep] and [(e["round"], e["dropped"]) for e in log] == [(r, cols[i]) for r, i in dropped]
    np.testing.assert_allclose([final[c] for c in kept], brute_vif(x[:, keep]), rtol=1e-6)


def test_gram_of_300_columns_with_nulls(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 300))
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(300)])
    df = spark.createDataFrame(pdf).withColumn("f7", F.when(F.col("f7") > 1.5, None).otherwise(F.col("f7")))
    cols, g, n = SEL.gram_matrix(df, pdf.columns)
    full = x[x[:, 7] <= 1.5]
    assert n == len(full) and np.allclose(g, full.T @ full)
    kept, log, final = SEL.vif_elimination(df, pdf.columns, 2.0)
    assert len(kept) + len(log) == 300 and max(final.values()) <= 2.0
    # the swept inverse equals one made anew from the columns kept
    np.testing.assert_allclose([final[c] for c in kept], brute_vif(full[:, [int(c[1:]) for c in kept]]), rtol=1e-6)
    assert SEL.gram_matrix(df.limit(0), ["f0", "f1"])[2] == 0


def test_equal_vifs_drop_the_first_column(spark):
    """The last two columns have equal VIFs but for rounding, whatever their scales."""
    from loanpanel.operators.select import vif_elimination
    for scale in (1.0, 3.7e5, 1.3e-4, 7.1e8):
        df = spark.createDataFrame([(i + 1.0, (i + 1.1 + i % 3) * scale) for i in range(40)], "a double, b double")
        assert vif_elimination(df, ["a", "b"], 2.0)[0] == ["b"]
