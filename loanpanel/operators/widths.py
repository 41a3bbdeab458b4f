"""Rolling ranges of every width at once, by doubling levels.

For a width m the rate of a frame is (max - min) / m over m consecutive rows of a loan, and a loan's rate is
the largest over its full frames.  Level k holds max and min of the 2^k rows from each position on; a
frame of width m, 2^k <= m < 2^(k+1), is the union of two overlapping frames of level k.  So all widths
come from one pass over positions with log2 levels; the plan does not depend on how long a loan is.

A loan of at most ``block_rows`` rows is one unit of work; many such loans are worked on as one array.  A
longer loan is cut into blocks, and its frames into units by the blocks in which they start and end: a
unit reads these two blocks and the max and min of everything between them.  No task ever holds a loan that
is longer than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.functions.segments import grouped_quantiles

DEFAULT_BLOCK_ROWS = 4096
BATCH_ROWS = 262_144


def rates_by_width(values: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """For each of several series, laid end to end, the largest rate of every width from 1 to its length.
    NaN marks a missing value: a frame that holds one does not count; no frame that counts gives NaN."""
    order = np.argsort(-lengths, kind="stable")              # longest first: the series that reach a width come first
    begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    sizes = lengths[order]
    first = np.concatenate(([0], np.cumsum(sizes)))
    take = np.arange(first[-1]) - np.repeat(first[:-1], sizes) + np.repeat(begin[order], sizes)
    high = low = values[take].astype(np.float64)
    left = np.repeat(sizes, sizes) - (np.arange(first[-1]) - np.repeat(first[:-1], sizes))       # rows from here to the end
    out = [np.full(n, np.nan) for n in lengths]
    level, width, most = 1, 1, int(sizes[0]) if len(sizes) else 0
    while width <= most:
        if width == 2 * level:                               # the next level: two frames of the last one
            high, low = np.maximum(high[:-level], high[level:]), np.minimum(low[:-level], low[level:])
            level = width
        reach = int(np.searchsorted(-sizes, -width, side="right"))          # series of at least this length
        shift, end = width - level, first[reach]
        n = min(end, len(high) - shift)
        top, low_ = np.maximum(high[:n], high[shift:shift + n]), np.minimum(low[:n], low[shift:shift + n])
        rate = np.full(end, np.nan)
        rate[:n] = np.where(left[:n] >= width, (top - low_) / width, np.nan)
        for k, x in zip(order[:reach].tolist(), np.fmax.reduceat(rate, first[:reach]).tolist()):
            out[k][width - 1] = x
        width += 1
    return out


def rates_across(start: np.ndarray, end: np.ndarray, between: int, high: float | None, low: float | None) -> np.ndarray:
    """The largest rate of each width from ``between`` + 2 on, over the frames that start in one block and
    end in another, with ``between`` rows of known max and min (None: no rows) in the middle."""
    up, down = np.maximum.accumulate(start[::-1]), np.minimum.accumulate(start[::-1])      # by rows taken from the first block's end
    up2, down2 = np.maximum.accumulate(end), np.minimum.accumulate(end)
    if high is not None:
        up, down = np.maximum(up, high), np.minimum(down, low)
    a, b = len(up), len(up2)
    out = np.full(a + b - 1, np.nan)
    for taken in range(2, a + b + 1):
        u0, u1 = max(1, taken - b), min(a, taken - 1)
        v = slice(taken - u1 - 1, taken - u0)
        spread = np.maximum(up[u0 - 1:u1], up2[v][::-1]) - np.minimum(down[u0 - 1:u1], down2[v][::-1])
        if not np.all(np.isnan(spread)):
            out[taken - 2] = np.nanmax(spread) / (between + taken)
    return out


def quantiles_of(values: np.ndarray, lengths: np.ndarray, qs: list[float]) -> np.ndarray:
    """Linear-interpolated quantiles of several series, laid end to end: one row per series, NaN where a
    series has no value.  NaN marks a missing value."""
    series = np.repeat(np.arange(len(lengths)), lengths)
    ordered = values[np.lexsort((values, series))]           # NaN come last in their series
    n = np.bincount(series[~np.isnan(values)], minlength=len(lengths))
    begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    out = np.full((len(lengths), len(qs)), np.nan)
    have = n > 0
    for j, q in enumerate(qs):
        at = q * (n[have] - 1)
        low = np.floor(at).astype(np.int64)
        a, b = ordered[begin[have] + low], ordered[begin[have] + np.ceil(at).astype(np.int64)]
        out[have, j] = a + (b - a) * (at - low)
    return out


def _column(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def _whole_series(batches: Iterator[pa.RecordBatch], qs: list[float]) -> Iterator[pa.RecordBatch]:
    """(loan, rates, quantiles) of the series in a sorted stream of (loan, upb)."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        codes = table.column(0).combine_chunks()
        values = table.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        at = np.flatnonzero(np.concatenate(([True], _differs(codes))))
        lengths = np.diff(np.append(at, len(codes)))
        rates = rates_by_width(values, lengths)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        points = quantiles_of(values, lengths, qs)
        steps = pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(qs))
        yield pa.RecordBatch.from_arrays([codes.take(pa.array(at)), pa.ListArray.from_arrays(pa.array(offsets), _column(np.concatenate(rates))),
                                          pa.ListArray.from_arrays(steps, _column(points.ravel()))], ["loan", "rates", "quantiles"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= BATCH_ROWS:                               # all but the last loan, which may go on
            table = pa.Table.from_batches(held)
            codes = table.column(0).combine_chunks()
            ends = np.flatnonzero(_differs(codes))
            if len(ends):
                yield from flush(table.slice(0, int(ends[-1]) + 1))
                held = table.slice(int(ends[-1]) + 1).to_batches()
                rows = sum(x.num_rows for x in held)
    if rows:
        yield from flush(pa.Table.from_batches(held))


def _differs(codes: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc
    return pc.not_equal(codes[1:], codes[:-1]).to_numpy(zero_copy_only=False)


def _block_pairs(rows: DataFrame, block_rows: int) -> DataFrame:
    """(loan, width, rate) of the loans cut into blocks, from (loan, pos, upb, n); several rows per width."""
    block = F.floor(F.col("pos") / block_rows).cast("int")
    rows = rows.withColumn("b", block).withColumn("last", F.floor((F.col("n") - 1) / block_rows).cast("int"))
    # what lies between two blocks: running max and min of the blocks behind the first one
    seen = rows.groupBy("loan", "b", "last").agg(F.max("upb").alias("high"), F.min("upb").alias("low"), F.count("upb").alias("have"), F.count(F.lit(1)).alias("size"))
    pairs = seen.where("b > 0").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    so_far = Window.partitionBy("loan", "a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    middle = pairs.select("loan", "a", F.col("b").alias("z"), F.lit(1).alias("role"), F.lit(0).cast("long").alias("pos"),
                          F.max("high").over(so_far).alias("x"), F.min("low").over(so_far).alias("y"),
                          F.coalesce(F.sum(F.col("size") - F.col("have")).over(so_far), F.lit(0)).alias("gaps"))
    as_start = rows.withColumn("z", F.explode(F.sequence(F.col("b"), F.col("last")))).select("loan", F.col("b").alias("a"), "z", F.lit(0).alias("role"), "pos", F.col("upb").alias("x"))
    as_end = rows.where("b > 0").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select("loan", "a", F.col("b").alias("z"), F.lit(2).alias("role"), "pos", F.col("upb").alias("x"))
    none = {"y": F.lit(None).cast("double"), "gaps": F.lit(0).cast("long")}
    units = middle.unionByName(as_start.withColumns(none)).unionByName(as_end.withColumns(none))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(parts, "loan", "a", "z").sortWithinPartitions("loan", "a", "z", "role", "pos")
    kind = rows.schema["loan"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, start, end, mid):
            loan, a, z = key
            if a == z:
                rate, first = rates_by_width(np.asarray(start), np.array([len(start)]))[0], 1
            else:
                between = (z - a - 1) * block_rows
                high, low, gaps = mid
                inside = (None, None) if not between else (np.nan, np.nan) if gaps else (high, low)
                rate, first = rates_across(np.asarray(start), np.asarray(end), between, *inside), between + 2
            return pa.RecordBatch.from_arrays([pa.array([loan] * len(rate)), pa.array(np.arange(first, first + len(rate)), pa.int64()), _column(rate)], ["loan", "width", "rate"])

        key, start, end, mid = None, [], [], None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for loan, a, z, role, x, y, gaps in zip(*cols):
                if key != (loan, a, z):
                    if key is not None:
                        yield done(key, start, end, mid)
                    key, start, end, mid = (loan, a, z), [], [], None
                if role == 1:
                    mid = (x, y, gaps)
                else:
                    (start if role == 0 else end).append(np.nan if x is None else x)
        if key is not None:
            yield done(key, start, end, mid)

    found = units.select("loan", "a", "z", "role", "x", "y", "gaps").mapInArrow(each, f"loan {kind}, width long, rate double")
    return found.where("rate is not null").groupBy("loan", "width").agg(F.max("rate").alias("rate"))


def series_measures(rows: DataFrame, qs: list[float], block_rows: int = DEFAULT_BLOCK_ROWS, segments: int | None = None) -> DataFrame:
    """(loan, rates, quantiles) from (loan, pos, upb, n): rates[m - 1] is the largest rate of width m, NULL
    where no full frame counts (widths beyond the last that counts may be left out), and the linear-interpolated
    quantiles ``qs`` of the balances.  ``pos`` runs from 0 to n - 1 in each loan; a NULL or NaN balance
    is missing.  Loans longer than a block are cut: frames by blocks, quantiles by rank."""
    upb = F.col("upb").cast("double")
    rows = rows.select("loan", "pos", F.when(~F.isnan(upb), upb).alias("upb"), "n")
    kind = rows.schema["loan"].dataType.simpleString()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = (rows.where(F.col("n") <= block_rows).repartition(parts, "loan").sortWithinPartitions("loan", "pos")
             .select("loan", "upb").mapInArrow(lambda b: _whole_series(b, qs), f"loan {kind}, rates array<double>, quantiles array<double>"))
    cut = rows.where(F.col("n") > block_rows)
    if cut.isEmpty():                                        # stops at the first row of a long loan
        return short
    by_width = _block_pairs(cut, block_rows).groupBy("loan").agg(F.map_from_entries(F.collect_list(F.struct("width", "rate"))).alias("m"))
    widest = F.array_max(F.map_keys("m"))
    long = by_width.select("loan", F.transform(F.sequence(F.lit(1).cast("long"), widest), lambda w: F.try_element_at("m", w)).alias("rates"))
    names = {f"q{i}": q for i, q in enumerate(qs)}
    points = F.array(*[F.col(c) for c in names]) if names else F.array().cast("array<double>")
    if names:
        long = long.join(grouped_quantiles(cut, ["loan"], "upb", names, segments), "loan", "left")
    return short.unionByName(long.select("loan", "rates", points.alias("quantiles")))


def rates_of_all_widths(rows: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(loan, rates) of :func:`series_measures`."""
    return series_measures(rows, [], block_rows).select("loan", "rates")
