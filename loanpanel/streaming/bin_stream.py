"""Incremental bin maintenance as a Structured Streaming job.

New loan files land in a folder; a file-source stream picks them up and
``foreachBatch`` numbers the batch's new loans behind those already binned.
As bins fill up one after another, a new loan's bin follows from its place
among all loans alone.

The map is kept as segments: a batch writes one with its new loans only,
and ``FAN_IN`` neighbouring segments of a level are merged into one of the
next level, so a loan is written again once per level (log of the number of
batches), not once per batch.  Nothing is ever changed in place: a segment
counts once its ``_SUCCESS`` file is there, and a batch that runs again
reads only the segments before it and overwrites its own, so a replay after
a failure gives the same result.  The batch's rows go, with their bins, to
``<data_dir>/batchId=<id>``, written by bin (``write_by_bin``).  Progress is tracked in the
stream's checkpoint, which lives in the shared checkpoint folder.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loanpanel.schema import MAX_BIN_OCCUPANCY
from loanpanel.sources.bins import dense_index, route_to_bins, with_occupancy, write_by_bin
from loanpanel.sources.delimited import staging_dir

FAN_IN = 8
_SEGMENT = re.compile(r"level=(\d+)_first=(\d+)_last=(\d+)$")


def _segments(spark: SparkSession, map_dir: str) -> list[tuple[int, int, int]]:
    """(level, first batch, last batch) of the complete segments."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(map_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [(m, st) for st in fs.listStatus(path) if (m := _SEGMENT.match(st.getPath().getName()))]
    return sorted(tuple(map(int, m.groups())) for m, st in found if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")))


def live_segments(segments: list[tuple[int, int, int]], before: int | None = None) -> list[tuple[int, int, int]]:
    """Of the segments whose batches all come before ``before``, those that no merged one covers, in order."""
    usable = [s for s in segments if before is None or s[2] < before]
    return sorted((s for s in usable if not any(t[0] > s[0] and t[1] <= s[1] and s[2] <= t[2] for t in usable)), key=lambda s: s[1])


def _path(map_dir: str, segment: tuple[int, int, int]) -> str:
    return f"{map_dir.rstrip('/')}/level={segment[0]}_first={segment[1]}_last={segment[2]}"


def _read(spark: SparkSession, map_dir: str, segments: list[tuple[int, int, int]]) -> DataFrame | None:
    return spark.read.parquet(*[_path(map_dir, s) for s in segments]) if segments else None


def latest_map(spark: SparkSession, map_dir: str, key: str = "loanSeqNumber") -> DataFrame | None:
    """The bin map of all batches so far (loan, binNumber, binOccupancy, maxBinOccupancy), or None when
    there is none yet."""
    found = _read(spark, map_dir, live_segments(_segments(spark, map_dir)))
    if found is None:
        return None
    return with_occupancy(found.select(key, "binNumber"), found.first()["maxBinOccupancy"]).select(
        key, "binNumber", "binOccupancy", "maxBinOccupancy")


def _merge(spark: SparkSession, map_dir: str, batch_id: int) -> None:
    """Merge the newest FAN_IN segments of a level, as long as a level has so many."""
    level = 0
    while True:
        own = [s for s in live_segments(_segments(spark, map_dir), batch_id + 1) if s[0] == level]
        if len(own) < FAN_IN:
            return
        merged = (level + 1, own[0][1], own[-1][2])
        _read(spark, map_dir, own).write.mode("overwrite").parquet(_path(map_dir, merged))
        level += 1


def add_batch(spark: SparkSession, batch: DataFrame, batch_id: int, map_dir: str, data_dir: str,
              key: str = "loanSeqNumber", capacity: int = MAX_BIN_OCCUPANCY) -> None:
    """One micro-batch: number its new loans, write them as a segment, route its rows."""
    known = _read(spark, map_dir, live_segments(_segments(spark, map_dir), batch_id))
    if known is not None and (other := known.first()) is not None and other["maxBinOccupancy"] != capacity:
        raise ValueError(f"the map's bins hold {other['maxBinOccupancy']} loans, not {capacity}")
    keys = batch.where(F.col(key).isNotNull()).select(key).distinct()
    new = keys if known is None else keys.join(known.select(key), key, "left_anti")
    total = 0 if known is None else known.count()               # row counts of Parquet footers
    place = dense_index(new, key, "__place") if keys.take(1) else new.withColumn("__place", F.lit(0))
    own = (0, batch_id, batch_id)
    (place.select(key, F.floor((F.col("__place") + total) / capacity).cast("int").alias("binNumber"), F.lit(capacity).alias("maxBinOccupancy"))
          .write.mode("overwrite").parquet(_path(map_dir, own)))
    bins = _read(spark, map_dir, [*live_segments(_segments(spark, map_dir), batch_id), own])
    write_by_bin(route_to_bins(batch, bins, key), f"{data_dir.rstrip('/')}/batchId={batch_id}", "overwrite", capacity)
    _merge(spark, map_dir, batch_id)


def start_bin_stream(spark: SparkSession, source: DataFrame, map_dir: str, data_dir: str,
                     checkpoint: str, key: str = "loanSeqNumber",
                     capacity: int = MAX_BIN_OCCUPANCY, available_now: bool = True) -> StreamingQuery:
    """Start the stream over ``source`` (a streaming DataFrame of loan rows; a NULL loan has no bin)."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # staged: a stream's own session plans without AQE, so every exchange of a batch, however small,
        # would keep all its partitions; read back by the caller's session it is planned as any table
        held = staging_dir(spark, f"bin-batch-{batch_id}")
        batch.write.parquet(held)
        rows = spark.read.schema(batch.schema).parquet(held)
        try:
            if not rows.isEmpty():
                add_batch(spark, rows, batch_id, map_dir, data_dir, key, capacity)
        finally:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(held)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    writer = source.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
