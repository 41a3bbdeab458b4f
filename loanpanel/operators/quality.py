"""Data-quality checks and column profiles.

Profiles over many columns are computed with one aggregate (one output
column per input column) or by unpivoting to (column, value) pairs and
grouping; the results are as small as the number of columns or values,
so the few decisions that drop columns collect only those summaries.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def _numeric_columns(df: DataFrame, exclude_name: str | None = None) -> list[str]:
    return [c for c, t in df.dtypes
            if (t in NUMERIC or t.startswith("decimal")) and not (exclude_name and exclude_name in c)]


def null_counts(df: DataFrame) -> DataFrame:
    """C4: (column_name, n_null, n_rows) for every column, one aggregate + unpivot."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[(F.count(F.lit(1)) - F.count(F.col(c))).alias(c) for c in cols])
    long = wide.unpivot("__n", cols, "column_name", "n_null")
    return long.select("column_name", F.col("n_null").cast("long"), F.col("__n").alias("n_rows"))


def all_null_columns(df: DataFrame) -> list[str]:
    """Columns that hold no value at all."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] == 0]


def assert_no_all_null(df: DataFrame) -> DataFrame:
    """Raise if any column is entirely NULL."""
    bad = all_null_columns(df)
    if bad:
        raise ValueError(f"column(s) with all NULL values: {bad}")
    return df


def drop_all_null(df: DataFrame) -> DataFrame:
    """C2."""
    return df.drop(*all_null_columns(df))


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with the same non-NULL value in every row."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in df.columns:
        aggs += [F.count(F.col(c)).alias(f"n|{c}"), F.min(F.col(c)).alias(f"lo|{c}"),
                 F.max(F.col(c)).alias(f"hi|{c}")]
    r = df.agg(*aggs).first()
    return [c for c in df.columns if r[f"n|{c}"] == r["__n"] and r["__n"] > 0 and r[f"lo|{c}"] == r[f"hi|{c}"]]


def column_profile(df: DataFrame) -> DataFrame:
    """C1-C3 as a table: column_name, n_rows, n_nonnull, all_null, is_constant."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs.append(F.struct(F.count(F.col(c)).alias("nn"),
                             (F.min(F.col(c)).cast("string") == F.max(F.col(c)).cast("string")).alias("same"))
                    .alias(f"c{i}"))
    wide = df.agg(*aggs)
    long = wide.select("__n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}.nn").alias("nn"), F.col(f"c{i}.same").alias("same"))
        for i, c in enumerate(cols)])).alias("s"))
    return long.select(
        F.col("s.column_name").alias("column_name"), F.col("__n").alias("n_rows"),
        F.col("s.nn").alias("n_nonnull"), (F.col("s.nn") == 0).alias("all_null"),
        ((F.col("s.nn") == F.col("__n")) & (F.col("__n") > 0) & F.coalesce(F.col("s.same"), F.lit(False)))
        .alias("is_constant"))


def drop_constant(df: DataFrame) -> DataFrame:
    """C3."""
    return df.drop(*constant_columns(df))


def assert_not_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Raise if any listed column has a NULL."""
    cols = list(columns)
    r = df.agg(*[F.count(F.when(F.col(c).isNull(), True)).alias(c) for c in cols]).first()
    bad = [c for c in cols if r[c]]
    if bad:
        raise ValueError(f"NULL values in {bad}")
    return df


def assert_unique(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Raise if a key repeats (checks the right side of a left join
    instead of counting the join)."""
    keys = list(keys)
    dup = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"key {keys} is not unique, e.g. {dup[0].asDict()}")
    return df


def safe_left_join(left: DataFrame, right: DataFrame, on, check: bool = True) -> DataFrame:
    """E2 + C6: left join that cannot add rows (right key checked unique)."""
    keys = [on] if isinstance(on, str) else list(on)
    if check:
        assert_unique(right, keys)
    return left.join(right, keys, "left")


def _as_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unpivot ``columns`` to (column_name, value string)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("kv")).select("kv.column_name", "kv.value")


def value_counts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column_name, value, count) for each value of each column (NULL included)."""
    cols = list(columns) if columns is not None else df.columns
    return _as_long(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def homogeneity(df: DataFrame, columns: Iterable[str] | None = None, thresh: float = 0.99) -> DataFrame:
    """Per column, the share of its most common non-NULL value;
    ``homogeneous`` when that share exceeds ``thresh``."""
    cols = list(columns) if columns is not None else df.columns
    vc = _as_long(df, cols).where(F.col("value").isNotNull()) \
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    per = vc.groupBy("column_name").agg(F.max("n").alias("top_n"), F.sum("n").alias("n_nonnull"))
    per = per.withColumn("top_share", F.col("top_n") / F.col("n_nonnull"))
    return per.withColumn("homogeneous", F.col("top_share") > F.lit(thresh))


def majority_values(df: DataFrame, columns: Iterable[str] | None = None, thresh: float = 0.99,
                    tracked: int = 1024) -> DataFrame:
    """C9 by majority candidates: (column_name, n_nonnull, majority_n, homogeneous) for each column.

    ``majority_n`` counts the value that more than half of the column's non-NULL rows hold (NULL if none
    does), and ``homogeneous`` says whether its share exceeds ``thresh``, which must be 0.5 or more.
    The first pass is one mergeable sketch of frequent values per column, of ``tracked`` counters at most,
    so its size and its shuffle don't depend on how many different values there are.  A value of over half
    the rows is always among a sketch's first four: the sketch is off by less than 1 % of the rows, so
    four others cannot come before it.  The second pass counts these candidates exactly.
    """
    if not 0.5 <= thresh <= 1:
        raise ValueError("thresh must be between 0.5 and 1")
    cols = list(columns) if columns is not None else df.columns
    values = df.select(*[F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, c in enumerate(cols)])
    first = values.agg(*[F.expr(f"approx_top_k(v{i}, 4, {tracked}) filter (where v{i} is not null)").alias(f"v{i}")
                         for i in range(len(cols))]).first()
    candidates = [[r["item"] for r in first[f"v{i}"] or () if r["item"] is not None] for i in range(len(cols))]
    found = values.agg(*[F.struct(F.lit(c).alias("column_name"), F.count(f"v{i}").alias("n_nonnull"),
                                  F.greatest(F.lit(0), F.lit(0), *[F.count(F.when(F.col(f"v{i}") == F.lit(v), 1))
                                                                   for v in candidates[i]]).alias("n")).alias(f"s{i}")
                         for i, c in enumerate(cols)])
    per = found.select(F.explode(F.array(*[f"s{i}" for i in range(len(cols))])).alias("s")).select("s.*")
    over = 2 * F.col("n") > F.col("n_nonnull")
    return per.select("column_name", "n_nonnull", F.when(over, F.col("n")).alias("majority_n"),
                      (over & (F.col("n") / F.col("n_nonnull") > thresh)).alias("homogeneous"))


def remove_homogeneity(df: DataFrame, thresh: float = 0.99, columns: Iterable[str] | None = None) -> DataFrame:
    """Drop the homogeneous columns."""
    profile = majority_values(df, columns, thresh) if thresh >= 0.5 else homogeneity(df, columns, thresh)
    return df.drop(*[r[0] for r in profile.where("homogeneous").select("column_name").collect()])


def variance_profile(df: DataFrame, thresh: float = 0.0, exclude_name: str | None = "Date") -> DataFrame:
    """Population variance of each numeric column (names containing
    ``exclude_name`` skipped); ``kept`` when the variance exceeds ``thresh``."""
    cols = _numeric_columns(df, exclude_name)
    wide = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "variance")
    return long.withColumn("kept", F.coalesce(F.col("variance") > F.lit(thresh), F.lit(False)))


def variance_threshold_select(df: DataFrame, thresh: float = 0.0) -> DataFrame:
    """Keep the numeric columns whose variance exceeds ``thresh``."""
    keep = [r[0] for r in variance_profile(df, thresh).where("kept").select("column_name").collect()]
    return df.select(*keep)


def _bin_expr(x, lo, hi, bins: int):
    """Equal-width bin of ``x`` in [lo, hi]; the top edge falls in the last
    bin; a zero-width range is widened by 0.5 each side (numpy's rule)."""
    same = hi == lo
    lo2 = F.when(same, lo - 0.5).otherwise(lo)
    width = F.when(same, F.lit(1.0 / bins)).otherwise((hi - lo) / F.lit(float(bins)))
    return F.least(F.floor((x - lo2) / width), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, columns: Iterable[str] | None = None, bins: int = 10) -> DataFrame:
    """C11: equal-width histogram per numeric column -> (column_name, bin, count)
    for non-empty bins.  Column ranges come from one aggregate and are inlined."""
    cols = list(columns) if columns is not None else _numeric_columns(df)
    r = df.agg(*[x for c in cols for x in (F.min(F.col(c).cast("double")).alias(f"lo|{c}"),
                                           F.max(F.col(c).cast("double")).alias(f"hi|{c}"))]).first()
    pairs = []
    for c in cols:
        lo, hi = r[f"lo|{c}"], r[f"hi|{c}"]
        if lo is None:
            continue
        b = _bin_expr(F.col(c).cast("double"), F.lit(lo), F.lit(hi), bins)
        pairs.append(F.struct(F.lit(c).alias("column_name"), b.alias("bin")))
    long = df.select(F.explode(F.array(*pairs)).alias("kb")).select("kb.column_name", "kb.bin")
    return long.where(F.col("bin").isNotNull()).groupBy("column_name", "bin") \
        .agg(F.count(F.lit(1)).alias("count"))


def histogram_by_group(df: DataFrame, group: str, column: str, bins: int = 10) -> DataFrame:
    """Per group, a histogram over the group's own range -> (group, bin, count).

    Group ranges are a ``groupBy``; they are joined back by key (AQE
    broadcasts them when their runtime size is small)."""
    x = F.col(column).cast("double")
    base = df.where(F.col(group).isNotNull() & x.isNotNull())
    rng = base.groupBy(group).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    j = base.select(group, x.alias("__x")).join(rng, group, "inner")
    b = _bin_expr(F.col("__x"), F.col("__lo"), F.col("__hi"), bins)
    return j.select(group, b.alias("bin")).groupBy(group, "bin").agg(F.count(F.lit(1)).alias("count"))
