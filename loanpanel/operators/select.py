"""Feature selection by variance inflation.

The only distributed step is one pass over the feature columns: every task adds up the packed upper triangle
of its rows' cross products (X'X, p(p+1)/2 numbers whatever the rows), and the triangles are summed by
position.  The elimination then runs on that small matrix, scaled to unit diagonal, on the driver: for column
i, regressing it on the remaining columns (no intercept, as the usual VIF helper does on the matrix it is
given) has residual sum of squares ``RSS_i``, and ``VIF_i = G_ii / RSS_i`` is the i-th diagonal element of the
scaled matrix's inverse; a column that exact combinations tie to others has an infinite VIF.  Dropping a
column takes one rank-one sweep of the inverse, so no new data pass is needed.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram_matrix(df: DataFrame, columns: Iterable[str]) -> tuple[list[str], np.ndarray, int]:
    """X'X over the rows without NULLs in ``columns``, and their number: one pass, one packed triangle per task."""
    cols = list(columns)
    p = len(cols)
    upper = np.triu_indices(p)
    base = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()

    def triangle(batches):
        total, n = np.zeros((p, p)), 0
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)])
            total += x.T @ x
            n += len(x)
        if n:
            packed = np.append(total[upper], float(n))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(packed)), pa.int32()), pa.array(packed)], ["at", "value"])

    summed = base.mapInArrow(triangle, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    packed = np.zeros(len(upper[0]) + 1)
    for at, value in summed.collect():              # p(p+1)/2 + 1 rows
        packed[at] = value
    g = np.zeros((p, p))
    g[upper] = packed[:-1]
    return cols, np.triu(g, 1).T + g, int(packed[-1])


def gram_long(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The Gram matrix as rows (col_i, col_j, value) for i <= j."""
    cols = list(columns)
    base = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    pairs = [(a, cols[j]) for i, a in enumerate(cols) for j in range(i, len(cols))]
    wide = base.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_i"), F.lit(b).alias("col_j"), F.col(f"`{a}|{b}`").alias("value"))
        for a, b in pairs])).alias("g")).select("g.*")


def _unit_inverse(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inverse of X'X scaled to unit diagonal, which columns are exact combinations of others).

    Scaled first, because the cut-off for zero is relative to the largest eigenvalue: on the raw matrix the
    columns of small scale would vanish as regressors (VIFs don't depend on scale)."""
    p = g.shape[0]
    size = np.sqrt(np.maximum(np.diag(g), 0.0))
    unit = np.where(size > 0, size, 1.0)
    value, vector = np.linalg.eigh(g / np.outer(unit, unit))
    null = value <= 1e-12 * max(p, 1)
    tied = (vector[:, null] ** 2).sum(axis=1) > 1e-9
    return (vector[:, ~null] / value[~null]) @ vector[:, ~null].T, tied


def vif_from_gram(g: np.ndarray) -> np.ndarray:
    """VIF of every column from X'X; inf where a column is an exact combination of the others."""
    inverse, tied = _unit_inverse(g)
    return np.where(tied, np.inf, np.diag(inverse))


def vif_elimination(df: DataFrame, columns: Iterable[str], thresh: float = 20.0,
                    drop_infinite_first: bool = False) -> tuple[list[str], list[dict], dict]:
    """J3 (threshold 20) / J4 (threshold 2, infinite VIFs dropped first).

    Repeatedly drops the column with the largest VIF while it exceeds
    ``thresh``.  Returns the kept columns, a log of every round and the
    final VIF of each kept column."""
    cols, g, _ = gram_matrix(df, columns)
    keep = list(range(len(cols)))
    log: list[dict] = []
    if drop_infinite_first:
        v = vif_from_gram(g[np.ix_(keep, keep)])
        for idx in [keep[i] for i in range(len(keep)) if np.isinf(v[i])]:
            log.append({"round": 0, "dropped": cols[idx], "vif": float("inf")})
        keep = [keep[i] for i in range(len(keep)) if not np.isinf(v[i])]
    rnd, inverse = 1, None
    while len(keep) > 1:
        if inverse is None:
            inverse, tied = _unit_inverse(g[np.ix_(keep, keep)])
        v = np.where(tied, np.inf, np.diag(inverse))
        m = int(np.argmax(v >= v.max() * (1 - 1e-9)))   # equal but for rounding (the last two always are): the first
        if not v[m] > thresh:
            break
        log.append({"round": rnd, "dropped": cols[keep[m]], "vif": float(v[m])})
        del keep[m]
        rnd += 1
        if tied.any():
            inverse = None                          # without this column others may be free again
        else:
            inverse = inverse - np.outer(inverse[:, m], inverse[m]) / inverse[m, m]
            inverse, tied = np.delete(np.delete(inverse, m, 0), m, 1), np.delete(tied, m)
    final = dict(zip([cols[i] for i in keep], vif_from_gram(g[np.ix_(keep, keep)]))) if keep else {}
    return [cols[i] for i in keep], log, final


def vif_table(df: DataFrame, columns: Iterable[str], thresh: float = 20.0,
              drop_infinite_first: bool = False) -> DataFrame:
    """J3/J4 as a table: column_name, final VIF (NULL when dropped), dropped_round."""
    kept, log, final = vif_elimination(df, columns, thresh, drop_infinite_first)
    rows = [(c, float(final[c]), None) for c in kept] + \
           [(e["dropped"], None, int(e["round"])) for e in log]
    return df.sparkSession.createDataFrame(rows, "column_name string, vif double, dropped_round int")
