"""Joins between loan tables.

All joins are equi-joins on the loan key (or a composite key).  No side is
broadcast by hint: AQE converts a join to a broadcast at runtime when the
measured size of one side is under ``spark.sql.autoBroadcastJoinThreshold``,
and keeps a shuffle join otherwise, so the choice is always size-checked.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.operators.quality import safe_left_join


def combine(origination: DataFrame, monthly: DataFrame, key: str = "loanSeqNumber",
            not_null: Iterable[str] = ("mthlyRepPeriod",)) -> DataFrame:
    """E1 + B10: origination ⋈ monthly (inner) with not-NULL row filters."""
    out = origination.join(monthly, key, "inner")
    present = [c for c in not_null if c in out.columns]
    return out.dropna(subset=present) if present else out


def add_loan_features(loan_level: DataFrame, features: DataFrame, key: str = "loanSeqNumber") -> DataFrame:
    """Left-join a feature table, guarded against row growth."""
    return safe_left_join(loan_level, features, key)


def semi_both(a: DataFrame, b: DataFrame, key: str = "loanSeqNumber") -> tuple[DataFrame, DataFrame]:
    """E5/H4: keep only loans present in both tables (two semi joins)."""
    ka, kb = a.select(key), b.select(key)
    return a.join(kb, key, "left_semi"), b.join(ka, key, "left_semi")


def only_new(df: DataFrame, known: DataFrame, key: str = "loanSeqNumber") -> DataFrame:
    """Rows whose key is not in ``known`` (anti join)."""
    return df.join(known.select(key), key, "left_anti")


def only_known(df: DataFrame, known: DataFrame, key: str = "loanSeqNumber") -> DataFrame:
    """Rows whose key is in ``known`` (semi join)."""
    return df.join(known.select(key), key, "left_semi")


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, order: str,
           out: str | None = None) -> DataFrame:
    """Dictionary lookup; when a key repeats, the value of the last
    entry by ``order`` wins (the mapping is reduced to one row per key
    with ``max_by`` - a partial aggregate - before the join)."""
    one = mapping.groupBy(key).agg(F.max_by(value, order).alias(out or value))
    return df.join(one, key, "left")


def distinct_keys(df: DataFrame, key: str = "loanSeqNumber") -> DataFrame:
    """H6/B13."""
    return df.select(key).distinct()


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """H3/A4: append frames by column name (missing columns become NULL)."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
