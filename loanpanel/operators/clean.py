"""Row filters, projections and casts used while cleaning loan files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.functions.exprs import parse_yyyymm
from loanpanel.functions.quantile import exact_medians


def clean_scores(df: DataFrame, score: str = "creditScore") -> DataFrame:
    """Drop NULL scores and scores containing a blank, cast to int and
    keep 2-3 digit values."""
    raw = F.col(score).cast("string")
    as_int = raw.try_cast("int")
    return (df.where(raw.isNotNull() & ~raw.contains(" "))
              .withColumn(score, as_int)
              .where(F.col(score).isNotNull() & F.length(F.col(score).cast("string")).isin(2, 3)))


def keep_date_shape(df: DataFrame, column: str = "firstPaymentDate",
                    parsed: str | None = None) -> DataFrame:
    """Keep values of 5-6 characters and parse them as ``yyyyMM``
    (five-character codes are month-padded; impossible months become NULL)."""
    s = F.trim(F.col(column).cast("string"))
    out = df.where(F.length(s).isin(5, 6))
    return out.withColumn(parsed or column, parse_yyyymm(column))


def clean_observations(df: DataFrame, source: str, score: str = "creditScore",
                       date: str = "firstPaymentDate") -> DataFrame | None:
    """Source-specific cleaning; loan sources get B1-B4, census data none."""
    if source in ("fannie", "freddie"):
        out = clean_scores(df, score)
        return keep_date_shape(out, date) if date in out.columns else out
    if source == "acs":
        return None
    raise ValueError(f"unknown source {source!r}")


def drop_name_patterns(df: DataFrame, patterns: Iterable[str] = ("Unnamed", "nknown"),
                       exact: Iterable[str] = ("", "Unknown")) -> DataFrame:
    """Drop columns whose name contains a pattern or equals a listed name."""
    pats, names = list(patterns), set(exact)
    return df.drop(*[c for c in df.columns if c in names or any(p in c for p in pats)])


def project_prefix(df: DataFrame, prefix: str = "orig", keep: Iterable[str] = ()) -> DataFrame:
    """Keep ``keep`` columns plus every column starting with ``prefix``."""
    keep = list(keep)
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefix) and c not in keep])


def suffix_rename(df: DataFrame, suffix: str, key: str = "loanSeqNumber") -> DataFrame:
    """``x -> x<suffix>`` for every column except the key."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c != key})


def promote_numeric(df: DataFrame) -> DataFrame:
    """Cast every numeric (non-string, non-date) column to double."""
    skip = {"string", "date", "timestamp", "timestamp_ntz", "boolean"}
    return df.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if t not in skip})


def best_effort_numeric(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Cast a string column to double only if every non-NULL value casts
    (one aggregate counts the failures of all columns at once)."""
    cols = list(columns) if columns is not None else [c for c, t in df.dtypes if t == "string"]
    if not cols:
        return df
    fails = df.agg(*[F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), True))
                     .alias(c) for c in cols]).first()
    return df.withColumns({c: F.col(c).cast("double") for c in cols if fails[c] == 0})


def median_impute(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """NULL -> exact column median, each column its own median (all
    columns' medians from shared aggregate passes, then inlined as literals)."""
    meds = exact_medians(df, list(columns))
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double"))
                           for c, m in meds.items()})


def constant_fill(df: DataFrame, values: dict) -> DataFrame:
    """D3: NULL -> a constant per column."""
    return df.fillna(values)


# The strings the source treats as missing.
SENTINELS = ("   ", "000")


def sentinel_to_median(df: DataFrame, columns: Iterable[str], sentinels=SENTINELS) -> DataFrame:
    """Sentinel strings and NULL -> the column median of the numeric values."""
    cols = list(columns)
    nulled = df.withColumns({
        c: F.when(F.col(c).cast("string").isin(list(sentinels)), F.lit(None))
            .otherwise((F.col(c).cast("string")).try_cast("double")) for c in cols})
    return median_impute(nulled, cols)
