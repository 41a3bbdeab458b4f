"""Exact column quantiles without holding the column in one task.

``percentile()`` is exact but merges a value->count map of the whole
column in one task; at terabyte scale a continuous column has too many
distinct values for that.  This module finds the exact order statistics by
bracket refinement instead:

1. one pass counts the non-null values ``n``; the wanted order statistics
   are ranks ``floor(q(n-1))`` and ``ceil(q(n-1))`` (linear interpolation,
   the same definition as numpy / ``percentile`` / ``quantile_cont``);
   (up to ``direct_max`` values a single exact ``percentile`` pass is used);
2. a column of more than ``direct_max`` values is staged once as Parquet, so
   that no later pass computes its input again; while the bracket holding the
   ranks has more than ``max_collect`` values, ``percentile_approx`` proposes
   split points inside it and one grouped count (the place among the splits is
   a binary search) says how many values lie between and on them: a rank
   on a split ends the search, any other narrows the bracket to
   the values strictly between two splits.  All ranks share their passes as
   long as they lie in one bracket;
3. the few values left in the bracket are sorted and the ranks read.

Every pass is a full-parallel aggregate returning a handful of numbers.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.session import ensure_checkpoint_dir

DEFAULT_MAX_COLLECT = 200_000
DIRECT_MAX = 1_000_000   # up to this many values one ``percentile`` pass is used
SPLITS = 64
ACCURACY = 10_000        # of the proposed splits only; what they bound is counted


def _ranks(n: int, q: float) -> tuple[int, int, float]:
    pos = q * (n - 1)
    lo = int(math.floor(pos))
    return lo, int(math.ceil(pos)), pos - lo


def exact_quantiles(df: DataFrame, column: str, qs, max_collect: int = DEFAULT_MAX_COLLECT,
                    direct_max: int = DIRECT_MAX) -> list:
    """Exact linear-interpolated quantiles of ``column`` (NULLs ignored).

    Columns of at most ``direct_max`` values take one ``percentile`` pass
    (its merged buffer holds at most that many distinct values); larger
    ones are narrowed by bracket refinement."""
    qs = list(qs)
    vals = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = vals.count()
    if n == 0:
        return [None for _ in qs]
    if n <= direct_max:
        got = vals.agg(F.percentile("v", F.array(*[F.lit(float(q)) for q in qs])).alias("p")).first()["p"]
        return list(got)
    return _large_quantiles(vals, n, qs, max_collect)


def _large_quantiles(vals: DataFrame, n: int, qs, max_collect: int) -> list:
    """Quantiles of the ``n`` values of ``vals``, too many for one ``percentile`` pass."""
    ranks = [_ranks(n, q) for q in qs]
    found = _order_stats(_staged(vals), n, sorted({k for k0, k1, _ in ranks for k in (k0, k1)}), max_collect)
    return [found[k0] if k1 == k0 else found[k0] + (found[k1] - found[k0]) * frac for k0, k1, frac in ranks]


def exact_median(df: DataFrame, column: str, max_collect: int = DEFAULT_MAX_COLLECT):
    return exact_quantiles(df, column, [0.5], max_collect)[0]


def exact_medians(df: DataFrame, columns, max_collect: int = DEFAULT_MAX_COLLECT,
                  direct_max: int = DIRECT_MAX) -> dict:
    """Exact medians of several columns: one counting pass for all of them,
    one ``percentile`` pass for every column of at most ``direct_max``
    values, bracket refinement only for larger ones."""
    cols = list(columns)
    if not cols:
        return {}
    ok = {c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols}
    counts = df.agg(*[F.count(F.when(ok[c], True)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    small = [c for i, c in enumerate(cols) if 0 < counts[f"n{i}"] <= direct_max]
    out = {c: None for i, c in enumerate(cols) if counts[f"n{i}"] == 0}
    if small:
        r = df.agg(*[F.percentile(F.when(ok[c], F.col(c).cast("double")), 0.5).alias(f"m{i}")
                     for i, c in enumerate(small)]).first()
        out.update({c: r[f"m{i}"] for i, c in enumerate(small)})
    for i, c in enumerate(cols):
        if c not in out:
            vals = df.where(ok[c]).select(F.col(c).cast("double").alias("v"))
            out[c] = _large_quantiles(vals, counts[f"n{i}"], [0.5], max_collect)[0]
    return out


def _staged(vals: DataFrame) -> DataFrame:
    """``vals`` written once under the shared checkpoint folder: the search reads it several times."""
    spark = vals.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/loanpanel-quantile-{uuid.uuid4().hex[:12]}"
    vals.write.parquet(path)
    return spark.read.schema("v double").parquet(path)


def _place(v, edges: list[float], a: int, b: int):
    """Place of ``v`` among ``edges[a:b]``: 2i between edges i-1 and i, 2i+1 on edge i."""
    if a == b:
        return F.lit(2 * a)
    m = (a + b) // 2
    return (F.when(v < edges[m], _place(v, edges, a, m)).when(v == edges[m], F.lit(2 * m + 1))
             .otherwise(_place(v, edges, m + 1, b)))


def _order_stats(vals: DataFrame, n: int, ks: list[int], max_collect: int) -> dict[int, float]:
    """Values of the 0-based ranks ``ks`` among ``n`` values."""
    v, found = F.col("v"), {}
    # brackets to search: open value bounds (None: none), values below, values inside, ranks in it
    todo = [(None, None, 0, n, list(ks))]
    while todo:
        lo, hi, below, inside, wanted = todo.pop()
        part = vals
        if lo is not None:
            part = part.where(v > lo)
        if hi is not None:
            part = part.where(v < hi)
        if inside <= max_collect:
            rows = part.orderBy("v").select("v").collect()
            found.update({k: rows[k - below][0] for k in wanted})
            continue
        fracs = [i / SPLITS for i in range(1, SPLITS)]
        edges = sorted(set(part.agg(F.percentile_approx("v", fracs, ACCURACY).alias("s")).first()["s"]))
        counted = part.groupBy(_place(v, edges, 0, len(edges)).alias("p")).count()
        counts = counted.agg(F.map_from_entries(F.collect_list(F.struct("p", "count"))).alias("c")).first()["c"]
        # the splits are values of the column, so every pass leaves some rows out
        start = below
        for p in range(2 * len(edges) + 1):
            end = start + counts.get(p, 0)
            here = [k for k in wanted if start <= k < end]
            i = p // 2
            if here and p % 2:
                found.update({k: edges[i] for k in here})
            elif here:
                todo.append((edges[i - 1] if i else lo, edges[i] if i < len(edges) else hi, start, end - start, here))
            start = end
    return found
