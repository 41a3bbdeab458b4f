"""The k-d partition tree against brute force, and how few rows a query meets on balanced features."""

import numpy as np
import pytest

from loanpanel.operators import model as M
from loanpanel.operators.neighbors import PartitionTree, box_distances, leaves_with


def frame(spark, points):
    return spark.createDataFrame([(i, i % 2, *map(float, p)) for i, p in enumerate(points)], "id long, y int, " + ", ".join(f"f{j} double" for j in range(points.shape[1])))


def points_of(kind):
    rng = np.random.default_rng(4)
    if kind == "balanced":
        return rng.normal(size=(500, 4))
    if kind == "ties":
        return rng.integers(0, 3, (400, 3)).astype(float)
    if kind == "half equal":
        x = rng.normal(size=(300, 2))
        x[::2] = x[0]
        return x
    return np.concatenate([rng.normal(size=(200, 3)) * 1e-3, rng.normal(size=(200, 3)) * 1e6])


@pytest.mark.parametrize("kind,leaf_rows", [("balanced", 4), ("balanced", 64), ("ties", 4), ("half equal", 4), ("two scales", 16)])
def test_neighbors_against_brute_force(spark, kind, leaf_rows):
    x = points_of(kind)
    df = frame(spark, x)
    feats = [f"f{j}" for j in range(x.shape[1])]
    got = {(r["q_key"], r["rank"]): r["t_key"] for r in M.knn_neighbors(df.where("id % 3 <> 0"), df.where("id % 3 = 0"), "id", feats, "y", 6, leaf_rows).collect()}
    train = [i for i in range(len(x)) if i % 3]
    for q in range(0, len(x), 3):
        d = 0.0
        for j in range(x.shape[1]):                          # summed up as the plan does
            d = d + (x[q, j] - x[train, j]) ** 2
        nearest = sorted(zip(d, train))[:6]
        assert [got[(q, r)] for r in range(1, 7)] == [t for _, t in nearest]


def test_fewer_training_rows_than_k(spark):
    df = frame(spark, np.arange(12.0).reshape(6, 2))
    got = M.knn_neighbors(df.where("id < 3"), df, "id", ["f0", "f1"], "y", 10)
    assert got.count() == 6 * 3 and got.where("rank > 3").count() == 0


def test_tree_routes_points_into_their_boxes():
    x = np.random.default_rng(1).normal(size=(3000, 5))
    tree = PartitionTree(x[:1000], 16)
    leaf = tree.leaf_of(x)
    assert leaf.min() >= 0 and leaf.max() < tree.leaves
    ids = np.unique(leaf)
    low, high = (np.array([f(x[leaf == i], axis=0) for i in ids]) for f in (np.min, np.max))
    d = box_distances(x, low, high)
    assert (d[np.arange(len(x)), np.searchsorted(ids, leaf)] == 0).all()
    counts = np.array([(leaf == i).sum() for i in ids])
    assert all(counts[v].sum() >= 40 for v in leaves_with(d[:50], counts, 40))
    assert PartitionTree(np.ones((50, 3)), 4).leaves == 1


def test_queries_meet_few_rows_on_standardised_features():
    """Four features of equal spread: the boxes within the k-th distance hold a small part of the rows."""
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(20_000, 4)), rng.normal(size=(200, 4))
    tree = PartitionTree(x, 64)
    leaf = tree.leaf_of(x)
    low, high = (np.array([f(x[leaf == i], axis=0) for i in range(tree.leaves)]) for f in (np.min, np.max))
    counts = np.bincount(leaf, minlength=tree.leaves)
    d = box_distances(q, low, high)
    met = []
    for p, boxes, own in zip(q, d, leaves_with(d, counts, 10)):
        rows = np.flatnonzero(np.isin(leaf, own))
        r2 = np.sort(((x[rows] - p) ** 2).sum(axis=1))[9]
        met.append(counts[boxes <= r2].sum())
    assert np.median(met) < 0.08 * len(x)
