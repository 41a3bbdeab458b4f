"""Statistics against published table values and numpy least squares."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from loanpanel.functions.exprs import two_sided_t_pvalue
from loanpanel.operators import select as SEL
from loanpanel.operators import series as S


@pytest.mark.parametrize("dof,t", [(1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (30, 2.042)])
def test_t_pvalue_at_tabulated_5pct_points(spark, dof, t):
    p = spark.range(1).select(two_sided_t_pvalue(F.lit(t), F.lit(dof)).alias("p")).first().p
    assert p == pytest.approx(0.05, abs=5e-4)


def test_t_pvalue_extremes(spark):
    r = spark.range(1).select(two_sided_t_pvalue(F.lit(0.0), F.lit(7)).alias("a"),
                              two_sided_t_pvalue(F.lit(50.0), F.lit(40)).alias("b")).first()
    assert r.a == pytest.approx(1.0) and r.b < 1e-10


def _ols_tau(y):
    dy = np.diff(y)
    X = np.column_stack([y[:-1], np.ones(len(dy))])
    beta, *_ = np.linalg.lstsq(X, dy, rcond=None)
    resid = dy - X @ beta
    s2 = resid @ resid / (len(dy) - 2)
    return beta[0] / math.sqrt(s2 * np.linalg.inv(X.T @ X)[0, 0])


def test_dickey_fuller_lag0_matches_numpy(spark):
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=60)) * 0.3 + rng.normal(size=60)
    rows = [("m", "s", i, float(v)) for i, v in enumerate(y)]
    series = spark.createDataFrame(rows, "MSA string, stat string, period int, value double")
    r = S.dickey_fuller(series, "MSA", "period").first()
    assert r.adf_stat == pytest.approx(_ols_tau(y), rel=1e-9)


def test_adf_autolag_stationary_vs_random_walk():
    rng = np.random.default_rng(5)
    noise = rng.normal(size=200)
    ar = np.zeros(200)
    for i in range(1, 200):
        ar[i] = 0.3 * ar[i - 1] + noise[i]
    walk = np.cumsum(noise)
    _, _, tau_ar = S.adf_autolag_one(ar)
    _, _, tau_walk = S.adf_autolag_one(walk)
    assert S._np_pvalue(tau_ar) < 0.01
    assert S._np_pvalue(tau_walk) > 0.05


def test_adf_autolag_lag0_equals_plain_regression():
    rng = np.random.default_rng(2)
    y = rng.normal(size=40).cumsum()
    nobs, lag, tau = S.adf_autolag_one(y, max_lag=0)
    assert lag == 0 and nobs == 39 and tau == pytest.approx(_ols_tau(y), rel=1e-9)


def test_normal_cdf(spark):
    r = spark.range(1).select(S.normal_cdf(F.lit(1.959964)).alias("a"), S.normal_cdf(F.lit(-1.0)).alias("b")).first()
    assert r.a == pytest.approx(0.975, abs=1e-6) and r.b == pytest.approx(0.158655, abs=1e-6)


def test_vif_matches_numpy_regressions(spark):
    rng = np.random.default_rng(4)
    x1 = rng.normal(size=200)
    x2 = x1 * 0.9 + rng.normal(size=200) * 0.3
    x3 = rng.normal(size=200)
    X = np.column_stack([x1, x2, x3])
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], "a double, b double, c double")
    cols, g, n = SEL.gram_matrix(df, ["a", "b", "c"])
    got = SEL.vif_from_gram(g)
    for i in range(3):
        others = np.delete(X, i, axis=1)
        beta, *_ = np.linalg.lstsq(others, X[:, i], rcond=None)
        r2 = 1 - ((X[:, i] - others @ beta) ** 2).sum() / (X[:, i] ** 2).sum()
        assert got[i] == pytest.approx(1 / (1 - r2), rel=1e-8)
    kept, log, _ = SEL.vif_elimination(df, ["a", "b", "c"], thresh=2.0)
    assert len(log) == 1 and log[0]["dropped"] in ("a", "b") and "c" in kept


def test_vif_infinite_column_dropped_first(spark):
    rows = [(float(i), float(i % 7), float(i) + float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    kept, log, _ = SEL.vif_elimination(df, ["a", "b", "c"], thresh=2.0, drop_infinite_first=True)
    assert {e["dropped"] for e in log if e["round"] == 0} == {"a", "b", "c"}
    assert kept == []


def test_models_run(spark):
    from loanpanel.plans import q_model as QM
    coefs = QM.logit(spark, SF_SMALL).collect()
    assert len(coefs) == len(QM.FEATURES) + 1
    acc = {r.k: r.accuracy for r in QM.knn(spark, SF_SMALL).collect()}
    assert set(acc) == set(range(1, 11)) and all(0.0 <= a <= 1.0 for a in acc.values())


def test_t_pvalue_large_dof_uses_bounded_approximation(spark):
    # for huge dof t is close to normal: 1.959964 -> 0.05; no long arrays are built
    r = spark.range(1).select(two_sided_t_pvalue(F.lit(1.959964), F.lit(50_000_000)).alias("p")).first()
    assert r.p == pytest.approx(0.05, abs=1e-6)
    near = spark.range(1).select(two_sided_t_pvalue(F.lit(2.0), F.lit(10_000)).alias("a"),
                                 two_sided_t_pvalue(F.lit(2.0), F.lit(10_001)).alias("b")).first()
    assert near.a == pytest.approx(near.b, abs=1e-6)


def test_vif_on_columns_of_mixed_scale():
    import numpy as np

    from loanpanel.operators.select import vif_from_gram
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 3)) + 2
    x = np.column_stack([base[:, 0] * 1e9, base[:, 1], base[:, 0] * 1e-3 + 1e-4 * base[:, 2], base[:, 2] * 50 + 7, base.sum(axis=1) + rng.normal(size=500) * 0.3])
    want = []
    for i in range(x.shape[1]):
        rest = np.delete(x, i, axis=1)
        rest = rest / np.linalg.norm(rest, axis=0)
        fit = rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        want.append((x[:, i] ** 2).sum() / ((x[:, i] - fit) ** 2).sum())
    assert np.allclose(vif_from_gram(x.T @ x), want, rtol=1e-5)
