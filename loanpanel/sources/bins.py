"""Loan bins: fixed-capacity groups of loans and their incremental update.

A bin holds up to ``capacity`` loans; the bin map (loan, binNumber,
binOccupancy, maxBinOccupancy) routes every later row of a loan to its bin,
and the data itself is written by bin (small neighbouring bins share a folder)
so a reader can prune to one bin.

Numbering loans densely (0, 1, 2, ... in loan-id order) is the only
ordered step.  It is done without a single-partition window: the keys are
range-partitioned and sorted, each partition counts its rows, the prefix
sums of those few counts give each partition's offset, and a row's index
is its offset plus its position inside the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.schema import MAX_BIN_OCCUPANCY
from loanpanel.session import cut_lineage


def dense_index(keys: DataFrame, key: str, out: str = "idx", partitions: int | None = None) -> DataFrame:
    """0-based dense index of the distinct ``key`` values in ascending order."""
    spark = keys.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (keys.select(key).distinct()
                  .repartitionByRange(n, key).sortWithinPartitions(key)
                  .withColumn("__pid", F.spark_partition_id())
                  .withColumn("__mid", F.monotonically_increasing_id()))
    # materialised: the counts and the positions below must come from the same partitioning
    ranged = cut_lineage(ranged)
    # monotonically_increasing_id = (partition id << 33) + row position in the partition
    ranged = ranged.withColumn("__local", F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33))
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: a size bound known up front, so broadcasting is safe
    offsets = counts.withColumn(
        "__off", F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)),
                            F.lit(0)))
    out_df = ranged.join(F.broadcast(offsets.select("__pid", "__off")), "__pid")
    return out_df.select(key, (F.col("__off") + F.col("__local")).alias(out))


def with_occupancy(bin_map: DataFrame, capacity: int, bin_col: str = "binNumber") -> DataFrame:
    """A15d: add the true occupancy of each bin and the capacity."""
    occ = bin_map.groupBy(bin_col).agg(F.count(F.lit(1)).cast("int").alias("binOccupancy"))
    return bin_map.join(occ, bin_col).withColumn("maxBinOccupancy", F.lit(capacity))


def create_bins(loans: DataFrame, key: str = "loanSeqNumber", capacity: int = MAX_BIN_OCCUPANCY) -> DataFrame:
    """Bin map for the distinct loans: ``binNumber = idx // capacity``."""
    idx = dense_index(loans, key)
    m = idx.select(key, F.floor(F.col("idx") / F.lit(capacity)).cast("int").alias("binNumber"))
    return with_occupancy(m, capacity).select(key, "binNumber", "binOccupancy", "maxBinOccupancy")


def update_bins(bin_map: DataFrame, new_rows: DataFrame, key: str = "loanSeqNumber",
                capacity: int | None = None) -> DataFrame:
    """Extend a bin map with the loans of a new batch.

    Known loans keep their bin (A15a).  New loans, in loan-id order, first
    fill the open bin - the one bin below capacity, if any - (A15b), then
    take new bins numbered from the highest bin + 1 (A15c).  The returned map
    carries the true occupancy of every bin (A15d)."""
    cap = capacity or bin_map.agg(F.max("maxBinOccupancy")).first()[0] or MAX_BIN_OCCUPANCY
    per_bin = bin_map.groupBy("binNumber").agg(F.count(F.lit(1)).alias("n"))
    s = per_bin.agg(F.max("binNumber").alias("top"),
                    F.min(F.when(F.col("n") < cap, F.col("binNumber"))).alias("open_bin"),
                    F.count(F.when(F.col("n") < cap, True)).alias("n_open"),
                    F.max(F.when(F.col("n") < cap, F.col("n"))).alias("open_n")).first()
    if s["n_open"] and s["n_open"] > 1:
        raise ValueError("bin map has more than one open bin")
    top = -1 if s["top"] is None else s["top"]
    open_bin = s["open_bin"]
    spots = (cap - s["open_n"]) if open_bin is not None else 0
    new = new_rows.select(key).distinct().join(bin_map.select(key), key, "left_anti")
    idx = dense_index(new, key)
    i = F.col("idx")
    bin_no = F.when(i < spots, F.lit(open_bin)) \
              .otherwise(F.lit(top + 1) + F.floor((i - F.lit(spots)) / F.lit(cap)))
    added = idx.select(key, bin_no.cast("int").alias("binNumber"))
    merged = bin_map.select(key, "binNumber").unionByName(added)
    return with_occupancy(merged, cap).select(key, "binNumber", "binOccupancy", "maxBinOccupancy")


def route_to_bins(rows: DataFrame, bin_map: DataFrame, key: str = "loanSeqNumber") -> DataFrame:
    """Attach the bin number to rows of mapped loans (inner join)."""
    return rows.join(bin_map.select(key, "binNumber"), key, "inner")


def bin_folder(capacity: int, bin_col: str = "binNumber") -> tuple[str, Column]:
    """The folder column of rows written by bin: the bin itself or, where bins are smaller than the usual
    ``MAX_BIN_OCCUPANCY``, the first of as many neighbouring bins as hold that many loans together."""
    bins = max(1, MAX_BIN_OCCUPANCY // capacity)
    b = F.col(bin_col)
    return (bin_col, b) if bins == 1 else ("firstBin", b - F.pmod(b, F.lit(bins)))


def write_by_bin(routed: DataFrame, path: str, mode: str, capacity: int = MAX_BIN_OCCUPANCY) -> str:
    """Write routed rows by bin. Each folder's rows are brought together first, so the files follow the loans,
    not bins times tasks (AQE splits a folder too large for a task); rows of small bins that share a
    folder are sorted by ``binNumber``, so Parquet's statistics still find one bin."""
    name, folder = bin_folder(capacity)
    (routed.withColumn(name, folder).hint("rebalance", F.col(name)).sortWithinPartitions(name, "binNumber")
           .write.mode(mode).partitionBy(name).parquet(path))
    return path


def write_binned(rows: DataFrame, bin_map: DataFrame, path: str, key: str = "loanSeqNumber",
                 mode: str = "append", capacity: int = MAX_BIN_OCCUPANCY) -> str:
    """Write rows by bin (:func:`write_by_bin`; readers prune by folder and bin)."""
    return write_by_bin(route_to_bins(rows, bin_map, key), path, mode, capacity)
