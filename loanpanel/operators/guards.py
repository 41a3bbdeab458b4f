"""Checks that come with the main job.

A check that counts rows or NULLs needs every row, and as a job of its own it reads the input once more.
Here the counts ride along as an ``Observation``: the rows pass through, the metrics arrive with the first
action on them, and ``verify`` raises what the source's checks raise.  The first action must read all
rows (a write or an aggregate does; ``take`` does not).  A watched stage keeps its columns from being pruned.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class RowChecks:
    """Counts of one place in a pipeline: rows, and non-NULL values of each column."""

    def __init__(self) -> None:
        self._seen: dict[str, tuple[Observation, list[str], list[str], bool]] = {}

    def watch(self, df: DataFrame, stage: str, not_null: Iterable[str] = (), no_all_null: bool = False) -> DataFrame:
        """``df``, observed under the name ``stage``.  ``not_null`` columns may hold no NULL (C5); with
        ``no_all_null`` every column must hold some value (C1).  Columns that ``df`` lacks are not checked."""
        if stage in self._seen:
            raise ValueError(f"stage {stage!r} is watched already")
        columns, seen = list(df.columns), Observation()
        self._seen[stage] = (seen, columns, [c for c in not_null if c in columns], no_all_null)
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)])

    def rows(self, stage: str) -> int:
        return self._seen[stage][0].get["rows"]

    def null_counts(self, stage: str) -> dict[str, int]:
        """C4: NULLs of each column, from the job that has run (waits for it)."""
        seen, columns, _, _ = self._seen[stage]
        return {c: seen.get["rows"] - seen.get[f"n{i}"] for i, c in enumerate(columns)}

    def verify(self, same_rows: Iterable[tuple[str, str]] = ()) -> None:
        """Raise ValueError if a check fails; ``same_rows`` are pairs of stages between which no row may be
        lost or added (C6).  Call it after an action on the rows."""
        for stage, (_, _, not_null, no_all_null) in self._seen.items():
            nulls, n = self.null_counts(stage), self.rows(stage)
            if no_all_null and n and (bad := [c for c, k in nulls.items() if k == n]):
                raise ValueError(f"{stage}: column(s) with all NULL values: {bad}")
            if bad := [c for c in not_null if nulls[c]]:
                raise ValueError(f"{stage}: NULL values in {bad}")
        for a, b in same_rows:
            if self.rows(a) != self.rows(b):
                raise ValueError(f"{self.rows(a)} rows in {a}, {self.rows(b)} in {b}")
