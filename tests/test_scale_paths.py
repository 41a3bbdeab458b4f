"""The skew-safe paths (chunks with halos, bracket-refined quantiles, dense
indices, exact k-NN) must give the same answers as the direct computation."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from loanpanel.functions.quantile import exact_quantiles
from loanpanel.operators import model as M
from loanpanel.operators import panel as P
from loanpanel.plans import driver_tables as T
from loanpanel.sources import bins as B

C = T.PANEL_COLS


def _rows(df, key):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("chunk", [1, 2, 3, 7])
def test_rolling_chunks_equal_unchunked(spark, chunk):
    p = T.panel(spark, SF_SMALL)
    big = P.add_upb_max_change_rate(p, C, widths=(1, 2, 3))
    small = P.add_upb_max_change_rate(p, C, widths=(1, 2, 3), chunk_rows=chunk)
    assert _rows(big, "loan") == _rows(small, "loan")


@pytest.mark.parametrize("chunk", [1, 2, 5])
def test_feature_table_chunks_equal_unchunked(spark, chunk):
    p = T.panel(spark, SF_SMALL)
    loans = T.loans(spark, SF_SMALL).select("loan", "score")
    a = P.loan_feature_table(p, loans, C)
    b = P.loan_feature_table(p, loans, C, chunk_rows=chunk)
    assert _rows(a, "loan") == _rows(b, "loan")


@pytest.mark.parametrize("chunk", [1, 2, 3])
def test_prior_default_chunks_equal_unchunked(spark, chunk):
    p = T.panel(spark, SF_SMALL)
    a = P.prior_default_rows(p, C).select("obs", "prior_mth", "mark")
    b = P.prior_default_rows(p, C, chunk_rows=chunk).select("obs", "prior_mth", "mark")
    assert _rows(a, "obs") == _rows(b, "obs")


def test_exact_quantiles_by_refinement(spark):
    vals = T.panel(spark, SF_SMALL).select("upb")
    arr = np.array([r[0] for r in vals.collect()])
    for q in (0.1, 0.5, 0.9):
        got = exact_quantiles(vals, "upb", [q], max_collect=50, direct_max=0)[0]
        assert got == pytest.approx(float(np.percentile(arr, q * 100)), rel=1e-12)


def test_exact_quantiles_with_ties(spark):
    df = spark.createDataFrame([(float(i % 3),) for i in range(1000)], "v double")
    assert exact_quantiles(df, "v", [0.5], max_collect=10, direct_max=0)[0] == 1.0
    assert exact_quantiles(df, "v", [0.5])[0] == 1.0


def test_dense_index_is_ordered_permutation(spark):
    keys = T.panel(spark, SF_SMALL).select("loan")
    idx = sorted((r.loan, r.idx) for r in B.dense_index(keys, "loan", partitions=5).collect())
    assert [i for _, i in idx] == list(range(len(idx)))


def test_bins_fixture(spark):
    first = spark.createDataFrame([(f"L{i:03d}",) for i in range(25)], "loanSeqNumber string")
    m = B.create_bins(first, capacity=10)
    occ = {r.binNumber: r.binOccupancy for r in m.select("binNumber", "binOccupancy").distinct().collect()}
    assert occ == {0: 10, 1: 10, 2: 5}
    more = spark.createDataFrame([(f"L{i:03d}",) for i in range(20, 32)], "loanSeqNumber string")
    m2 = B.update_bins(m, more, capacity=10)
    occ2 = {r.binNumber: r.binOccupancy for r in m2.select("binNumber", "binOccupancy").distinct().collect()}
    assert occ2 == {0: 10, 1: 10, 2: 10, 3: 2}
    assert m2.count() == m2.select("loanSeqNumber").distinct().count() == 32


def test_knn_exact_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(300, 3)) * np.array([50.0, 1.0, 0.1])
    lab = (pts[:, 1] > 0).astype(int)
    rows = [(i, int(lab[i]), *map(float, pts[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, c double")
    train, test = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    got = M.knn_neighbors(train, test, "id", ["a", "b", "c"], "y", k=5, per_bucket=8)
    got = {(r.q_key, r.rank): r.t_key for r in got.collect()}
    tr_ids = [i for i in range(300) if i % 3]
    for q in [i for i in range(300) if i % 3 == 0]:
        d = sorted((float(((pts[q] - pts[t]) ** 2).sum()), t) for t in tr_ids)[:5]
        assert [got[(q, r)] for r in range(1, 6)] == [t for _, t in d]


def test_panel_dates_are_dates(spark):
    r = T.panel(spark, SF_SMALL).select("d", "month").first()
    assert isinstance(r.d, dt.date) and r.month.day == 1
    assert T.panel(spark, SF_SMALL).where(F.col("status").isNull()).count() == 0


def test_hot_loan_is_split_across_chunks(spark):
    """One loan with a third of all rows: no (loan, chunk) group exceeds the
    chunk size plus its halo, and the features equal the unchunked ones."""
    hot = [(1, i, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(1000 - (i * 7) % 13), i % 3)
           for i in range(600)]
    cold = [(100 + k, 10_000 + k * 10 + j, dt.date(2000, 1, 1) + dt.timedelta(days=j), float(50 + j), 0)
            for k in range(60) for j in range(20)]
    p = spark.createDataFrame(hot + cold, "loan long, obs long, d date, upb double, status int")
    ranked = P.ranked_rows(p, C)
    chunked = P._with_chunks(ranked, C, 3, 50)
    biggest = chunked.groupBy("loan", "_part").count().agg(F.max("count")).first()[0]
    assert biggest <= 50 + 2
    loans = p.select("loan").distinct().withColumn("score", F.lit(700))
    a = P.loan_feature_table(p, loans, C)
    b = P.loan_feature_table(p, loans, C, chunk_rows=50)
    assert _rows(a, "loan") == _rows(b, "loan")


def test_knn_exact_with_heavy_tie_on_first_axis(spark):
    rng = np.random.default_rng(9)
    a = np.where(rng.random(400) < 0.6, 100.0, rng.normal(size=400) * 80.0)   # 60 % share one value
    pts = np.column_stack([a, rng.normal(size=400) * 5.0, rng.normal(size=400)])
    lab = (pts[:, 2] > 0).astype(int)
    df = spark.createDataFrame([(i, int(lab[i]), *map(float, pts[i])) for i in range(400)],
                               "id long, y int, a double, b double, c double")
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    got = M.knn_neighbors(train, test, "id", ["a", "b", "c"], "y", k=4, per_bucket=8)
    got = {(r.q_key, r.rank): r.t_key for r in got.collect()}
    tr_ids = [i for i in range(400) if i % 4]
    for q in [i for i in range(400) if i % 4 == 0]:
        d = sorted((float(((pts[q] - pts[t]) ** 2).sum()), t) for t in tr_ids)[:4]
        assert [got[(q, r)] for r in range(1, 5)] == [t for _, t in d]


def test_exact_medians_batch_equals_single(spark):
    from loanpanel.functions.quantile import exact_median, exact_medians
    p = T.panel(spark, SF_SMALL).select("upb", "status", F.lit(None).cast("double").alias("empty"))
    got = exact_medians(p, ["upb", "status", "empty"])
    assert got["upb"] == exact_median(p, "upb") and got["status"] == exact_median(p, "status")
    assert got["empty"] is None
    forced = exact_medians(p, ["upb"], max_collect=40, direct_max=0)
    assert forced["upb"] == pytest.approx(got["upb"], rel=1e-12)


def test_knn_exact_with_duplicate_points(spark):
    rng = np.random.default_rng(11)
    pts = rng.normal(size=(300, 2)) * np.array([10.0, 1.0])
    pts[:150] = pts[0]                                  # half the rows are one identical point
    lab = (rng.random(300) < 0.5).astype(int)
    df = spark.createDataFrame([(i, int(lab[i]), *map(float, pts[i])) for i in range(300)],
                               "id long, y int, a double, b double")
    train, test = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    got = M.knn_neighbors(train, test, "id", ["a", "b"], "y", k=5, per_bucket=8)
    got = {(r.q_key, r.rank): (r.t_key, r.t_label) for r in got.collect()}
    tr_ids = [i for i in range(300) if i % 3]
    for q in [i for i in range(300) if i % 3 == 0]:
        d = sorted((float(((pts[q] - pts[t]) ** 2).sum()), t) for t in tr_ids)[:5]
        assert [got[(q, r)] for r in range(1, 6)] == [(t, int(lab[t])) for _, t in d]
