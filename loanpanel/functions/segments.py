"""Cutting an order into segments, so that no task needs a whole group.

A position, a rank or a quantile inside a group asks for the group's rows in order.  A window over the
group would put them into one task, however large the group is.  Here the order is cut at quantiles of
*all* rows instead: a segment of a group then holds at most about ``1 / parts`` of the whole table (rows
that tie in the order column aside), and the groups' segments are hashed apart.  What the earlier segments
of a group add up to (the carry) comes from a window over the segments' counts, a small table.

The cuts are plain numbers, taken once: a row's segment depends on its value alone, so a task that is run
again puts every row where it was before.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanpanel.session import cut_lineage


def order_number(df: DataFrame, column: str) -> Column:
    """A double that never decreases along ``column``'s order (strings: by their first seven bytes)."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def order_cuts(df: DataFrame, number: Column, parts: int) -> list[float]:
    """At most ``parts`` - 1 values that cut the rows of ``df`` into parts of about equal size."""
    wanted = [i / parts for i in range(1, parts)]
    if not wanted:
        return []
    v = F.when(number.isNotNull() & ~F.isnan(number), number)
    found = df.agg(F.percentile_approx(v, wanted, max(10_000, 20 * parts)).alias("cuts")).first()["cuts"] or []
    return sorted({x for x in found if math.isfinite(x)})


def with_segment(df: DataFrame, column: str, name: str = "_seg", parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the number of the segment in which ``column`` lies (NULL and NaN: the first and
    the last, as Spark orders them).  ``parts`` is the session's number of shuffle partitions by default."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = order_number(df, column)
    cuts = order_cuts(df, number, parts)
    if not cuts:
        return df.withColumn(name, F.when(number.isNull(), -1).when(F.isnan(number), 1).otherwise(0))
    cut = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__number__", outputCol="__segment__", handleInvalid="keep")
    out = cut.transform(df.withColumn("__number__", number))
    seg = F.when(number.isNull(), -1).otherwise(F.col("__segment__").cast("int"))
    return out.withColumn(name, seg).drop("__number__", "__segment__")


def grouped_quantiles(df: DataFrame, group, value: str, qs: dict[str, float], parts: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per group: one row per group that has a value, with
    the columns named in ``qs``.  NULL and NaN values are left out.

    Equal values of a group are first counted together (map-side) and staged.  The counts per (group, segment) say in
    which segments the wanted ranks lie; only those are looked at row by row, by a window over
    (group, segment).  Nothing holds a group's values together.
    """
    group = list(group)
    number = F.col(f"`{value}`").cast("double")
    counts = (df.where(number.isNotNull() & ~F.isnan(number)).select(*group, number.alias("__v"))
              .groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__n")))
    counts = with_segment(cut_lineage(counts), "__v", "__seg", parts)
    per = counts.groupBy(*group, "__seg").agg(F.sum("__n").alias("__rows"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
              .withColumn("__total", F.sum("__rows").over(whole)))
    ranks = {}
    for name, q in qs.items():
        at = F.lit(float(q)) * (F.col("__total") - 1)
        ranks[name] = (F.floor(at), F.ceil(at), at - F.floor(at))
    lies = lambda k, first, n: (k >= F.col(first)) & (k < F.col(first) + F.col(n))      # noqa: E731
    wanted = F.lit(False)
    for low, high, _ in ranks.values():
        wanted = wanted | lies(low, "__before", "__rows") | lies(high, "__before", "__rows")
    keys = [*group, "__seg"]
    same = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
    joined = counts.alias("l").join(per.where(wanted).alias("r"), same).select("l.*", "r.__before", "r.__total")
    inside = Window.partitionBy(*keys).orderBy("__v")
    placed = joined.withColumn("__first", F.col("__before") + F.sum("__n").over(inside) - F.col("__n"))
    picked = []
    for i, (low, high, part) in enumerate(ranks.values()):
        picked += [F.max(F.when(lies(low, "__first", "__n"), F.col("__v"))).alias(f"__low{i}"),
                   F.max(F.when(lies(high, "__first", "__n"), F.col("__v"))).alias(f"__high{i}"),
                   F.max(part).alias(f"__part{i}")]
    found = placed.groupBy(*group).agg(*picked)
    value_of = lambda i: F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * F.col(f"__part{i}")      # noqa: E731
    return found.select(*[F.col(f"`{g}`") for g in group], *[value_of(i).alias(name) for i, name in enumerate(qs)])
