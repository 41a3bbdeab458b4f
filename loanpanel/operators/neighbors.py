"""Exact k nearest neighbours over a k-d partition tree (K5).

A tree cuts the training rows at medians of the axis with the widest spread, down to leaves of a few rows;
rows with equal values on that axis stay together, and the next cut takes another axis.  Its shape comes
from a bounded sample; every training row is then routed to its leaf, and the leaves' bounding boxes and
counts are taken over all rows.  A query first meets the rows of the nearest leaves that hold at least k of
them, which bounds its k-th distance by r, and then the rows of exactly those leaves whose box is no
farther than r.  Both meetings are equi-joins on the leaf; AQE splits a leaf that many queries ask for.

Distances to boxes are summed up axis by axis in the order in which distances to rows are, so rounding
cannot put a row nearer than its box.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.session import cut_lineage

SAMPLE_ROWS = 262_144           # training rows that the tree's shape is taken from, at most
NEAREST = 32                    # leaves ordered at first to find k rows; more where they do not suffice


class PartitionTree:
    """Cuts of a k-d tree: ``axis`` and ``cut`` per node; a child below 0 is leaf ``-1 - child``."""

    def __init__(self, points: np.ndarray, leaf_points: int) -> None:
        self.axis, self.cut, self.low, self.high, self.leaves = [], [], [], [], 0
        todo = [(points, None, None)]
        while todo:
            rows, parent, side = todo.pop()
            found = self._best_cut(rows) if len(rows) > leaf_points else None
            if found is None:
                child, self.leaves = -1 - self.leaves, self.leaves + 1
            else:
                child, (axis, cut) = len(self.axis), found
                self.axis.append(axis)
                self.cut.append(cut)
                self.low.append(0)
                self.high.append(0)
                above = rows[:, axis] >= cut
                todo += [(rows[~above], child, self.low), (rows[above], child, self.high)]
            if parent is not None:
                side[parent] = child
        self.axis, self.cut = np.asarray(self.axis, np.int64), np.asarray(self.cut, np.float64)
        self.low, self.high = np.asarray(self.low, np.int64), np.asarray(self.high, np.int64)

    @staticmethod
    def _best_cut(rows: np.ndarray) -> tuple[int, float] | None:
        """The median of the axis with the widest spread that has two sides; None where all rows are equal."""
        spread = rows.max(axis=0) - rows.min(axis=0)
        for axis in np.argsort(-spread, kind="stable"):
            if not spread[axis] > 0:
                return None
            values = np.sort(rows[:, axis])
            middle = values[len(values) // 2]
            if middle > values[0]:
                return int(axis), float(middle)
            return int(axis), float(values[np.searchsorted(values, middle, side="right")])
        return None

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64) if len(self.axis) else np.full(len(points), -1, np.int64)
        active = np.flatnonzero(node >= 0)
        while len(active):
            at = node[active]
            above = points[active, self.axis[at]] >= self.cut[at]
            node[active] = np.where(above, self.high[at], self.low[at])
            active = active[node[active] >= 0]
        return -1 - node


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of every point to every box."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        x = points[:, j, None]
        gap = np.where(x < low[:, j], x - low[:, j], np.where(x > high[:, j], x - high[:, j], 0.0))
        out += gap * gap
    return out


def leaves_with(distances: np.ndarray, counts: np.ndarray, need: int) -> list[np.ndarray]:
    """For each point, its nearest boxes until they hold ``need`` rows."""
    out = []
    first = min(NEAREST, distances.shape[1])
    for row in distances:
        near = np.argpartition(row, first - 1)[:first]
        near = near[np.argsort(row[near], kind="stable")]
        if counts[near].sum() < need:
            near = np.argsort(row, kind="stable")
        out.append(near[:int(np.searchsorted(np.cumsum(counts[near]), need)) + 1])
    return out


def tree_neighbors(train: DataFrame, test: DataFrame, feats: list[str], k: int, leaf_rows: int,
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(q_key, rank, t_key, t_label, sqdist): the ``k`` nearest rows of ``train`` (t_key, t_label, features)
    for every row of ``test`` (q_key, features), ties by t_key.  Features are doubles without NULL or NaN."""
    n = train.count()
    empty = (test.join(train.select("t_key", "t_label"), F.col("q_key") == F.col("t_key"))
             .select("q_key", F.lit(0).alias("rank"), "t_key", "t_label", F.lit(0.0).alias("sqdist")).limit(0))
    if not n:
        return empty
    share = min(1.0, 0.9 * sample_rows / n)
    sample = np.asarray([tuple(r) for r in train.select(*feats).sample(share, 7).limit(sample_rows).collect()], np.float64).reshape(-1, len(feats))
    tree = PartitionTree(sample, max(2, math.ceil(leaf_rows * len(sample) / n))) if len(sample) else PartitionTree(np.zeros((1, len(feats))), 2)

    @F.pandas_udf("int")
    def leaf(*columns: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf_of(np.column_stack([c.to_numpy() for c in columns])))

    tr = cut_lineage(train.withColumn("__leaf", leaf(*feats)))
    boxes = tr.groupBy("__leaf").agg(F.count(F.lit(1)).alias("n"), *[F.min(f).alias(f"lo{i}") for i, f in enumerate(feats)],
                                     *[F.max(f).alias(f"hi{i}") for i, f in enumerate(feats)]).collect()     # one row per leaf
    ids, counts = np.array([b["__leaf"] for b in boxes]), np.array([b["n"] for b in boxes])
    low = np.array([[b[f"lo{i}"] for i in range(len(feats))] for b in boxes])
    high = np.array([[b[f"hi{i}"] for i in range(len(feats))] for b in boxes])
    need = min(k, n)
    step = max(1, 4_000_000 // len(ids))                     # points whose distances to all boxes are held at once

    @F.pandas_udf("array<int>")
    def nearest(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy() for c in columns])
        return pd.Series([ids[v] for i in range(0, len(x), step) for v in leaves_with(box_distances(x[i:i + step], low, high), counts, need)])

    @F.pandas_udf("array<int>")
    def within(r2: pd.Series, *columns: pd.Series) -> pd.Series:
        x, r = np.column_stack([c.to_numpy() for c in columns]), r2.to_numpy()[:, None]
        return pd.Series([ids[v] for i in range(0, len(x), step) for v in box_distances(x[i:i + step], low, high) <= r[i:i + step]])

    def top_k(queries: DataFrame) -> DataFrame:
        asks = queries.select("q_key", *feats, F.explode("__leaves").alias("__leaf"))
        rows = tr.select("__leaf", "t_key", "t_label", *[F.col(f).alias(f"t_{f}") for f in feats])
        d = None
        for f in feats:
            diff = F.col(f) - F.col(f"t_{f}")
            d = diff * diff if d is None else d + diff * diff
        met = asks.join(rows, "__leaf").select("q_key", "t_key", "t_label", d.alias("sqdist"))
        w = Window.partitionBy("q_key").orderBy("sqdist", "t_key")
        return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    bound = top_k(test.withColumn("__leaves", nearest(*feats))).groupBy("q_key").agg(F.max("sqdist").alias("__r2"))
    asking = cut_lineage(test.join(bound, "q_key").withColumn("__leaves", within("__r2", *feats)).drop("__r2"))
    return top_k(asking).select("q_key", "rank", "t_key", "t_label", "sqdist")
