"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size. For a block every candidate is scored (integers), and
the k-th best score of each query is located by rounds of global histograms: a round cuts the query's
bracket into bins, every task counts its scores by bin, the counts are summed, and the bin holding the
k-th value becomes the next bracket, until it is one score wide. A task leaves out bins below its own
k-th score: they cannot hold the global one. A last pass keeps scores above the k-th value and, among
those equal to it, each task's smallest ids, as many as are missing; a query gathers at most k rows of
each task, and its rows are ordered by score and id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.llm.common import write_stage

BINS = 256


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null where the vector or a component is null or not
    finite. A finite component that no long can hold after scaling is an error."""
    scaled = F.transform(vector, lambda v: v.cast("double") * F.lit(float(scale)))
    whole = F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    large = F.exists(scaled, lambda v: F.abs(v) >= F.lit(2.0 ** 63))
    error = F.raise_error(F.lit(f"a vector component times {scale} does not fit a long")).cast("array<bigint>")
    return F.when(finite, F.when(large, error).otherwise(whole))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as integers, shorter ones filled with zeros."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return flat[offsets[0]:offsets[-1]].reshape(-1, width).astype(np.int64, copy=False)
    out = np.zeros((len(lengths), width), np.int64)
    for i, n in enumerate(lengths):
        n = min(n, width)
        out[i, :n] = flat[offsets[i]:offsets[i] + n]
    return out


NEVER = np.iinfo(np.int64).min


class _Block:
    """A bounded block of queries; goes to the tasks with the code."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.doubles = vectors.astype(np.float64)
        self.weight = np.abs(self.doubles).sum(axis=1)         # a query's scores are at most this times the largest component

    def scores(self, batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(candidate ids, scores[query, candidate]) by slices; a query's own row gets the lowest score."""
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                own = self.ids[:, None] == ids[None, :]
                s = self.product(_matrix(part.column(1), self.vectors.shape[1]), own)
                s[own] = NEVER
                yield ids, s

    def product(self, m: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Exact inner products; pairs that might pass a long are taken in unbounded integers, and it is an
        error if one does (other than a query with its own row, which is no candidate)."""
        doubles = m.astype(np.float64)
        largest = np.abs(doubles).max(axis=1, initial=0)
        top = self.weight.max(initial=0) * largest.max(initial=0)
        if top < 2 ** 52:                       # every partial sum is exact in doubles
            return (self.doubles @ doubles.T).astype(np.int64)
        s = self.vectors @ m.T                  # wraps around where a pair is too large
        if top >= 2 ** 62:
            q = np.flatnonzero(self.weight * largest.max() >= 2 ** 62)
            c = np.flatnonzero(self.weight.max() * largest >= 2 ** 62)
            exact = self.vectors[q].astype(object) @ m[c].T.astype(object)
            exact[own[np.ix_(q, c)]] = 0
            if (np.abs(exact) >= 2 ** 63).any():
                raise OverflowError("a score does not fit a long")
            s[np.ix_(q, c)] = exact.astype(np.int64)
        return s


def _above(s: np.ndarray, low: np.ndarray) -> np.ndarray:
    """s - low where s >= low, as unsigned numbers: the difference of two longs may pass a long."""
    return s.astype(np.uint64) - low.astype(np.uint64)[:, None]


def _top_counts(block: _Block, low: np.ndarray, width: int):
    """A task's histogram of each query's bracket, without the bins below its own k-th score."""
    def run(batches):
        hist = np.zeros((len(block.ids), BINS + 2), np.int64)      # below, the bins, above
        span = np.arange(len(block.ids))[:, None] * (BINS + 2)
        for _, s in block.scores(batches):
            # the lowest score marks a query's own row; it is dropped, also where every score is low
            over = np.minimum(_above(np.maximum(s, low[:, None]), low) // np.uint64(width), np.uint64(BINS)).astype(np.int64)
            bin_ = np.where(s < low[:, None], 0, over + 1)
            hist += np.bincount((bin_ + span)[s != NEVER].ravel(), minlength=hist.size).reshape(hist.shape)
        if hist.any():
            above = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1] - hist     # counts in higher bins
            q, j = np.nonzero((hist > 0) & (above < block.k))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(j, pa.int64()), pa.array(hist[q, j], pa.int64())], ["q", "bin", "n"])
    return run


def _winners(block: _Block, kth: np.ndarray, missing: np.ndarray):
    """A task's rows above the k-th score, and its smallest ids among those equal to it."""
    def run(batches):
        best: dict[int, list[int]] = {}
        for ids, s in block.scores(batches):
            q, j = np.nonzero((s > kth[:, None]) & (s != NEVER))
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[q], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(s[q, j], pa.int64())], ["query_id", "vec_id", "score"])
            order = np.argsort(ids, kind="stable")
            for i in np.flatnonzero(((s == kth[:, None]) & (s != NEVER)).any(axis=1)):
                if missing[i]:
                    same = ids[order][s[i, order] == kth[i]][:missing[i]]
                    best[i] = sorted([*best.get(i, ()), *same.tolist()])[:missing[i]]
        rows = [(block.ids[i], v, kth[i]) for i, vs in best.items() for v in vs]
        if rows:
            q, v, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, v, s)], ["query_id", "vec_id", "score"])
    return run


def _kth_scores(rows: DataFrame, block: _Block) -> tuple[np.ndarray, np.ndarray]:
    """(k-th best score of each query, how many rows equal to it are wanted), by histogram rounds."""
    n = len(block.ids)
    largest = rows.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()[0] or 0
    # no score is beyond this; the bracket ends where a long does
    reach = min(sum(map(int, np.abs(block.vectors).max(axis=0, initial=0))) * int(largest) + 1, 2 ** 63 - 1)
    low, missing, width = np.full(n, -reach, np.int64), np.full(n, block.k, np.int64), -(-(2 * reach + 1) // BINS)
    down = Window.partitionBy("q").orderBy(F.col("bin").desc())
    while True:
        summed = (rows.mapInArrow(_top_counts(block, low, width), "q long, bin long, n long")
                  .groupBy("q", "bin").agg(F.sum("n").alias("n")))
        # the highest bin by which k rows are counted; a query with fewer rows: its lowest bin
        cum = summed.withColumn("upto", F.sum("n").over(down)).withColumn("last", F.min("bin").over(Window.partitionBy("q")))
        hit = cum.where((F.col("upto") >= block.k) | (F.col("bin") == F.col("last"))).groupBy("q").agg(
            F.max(F.struct("bin", "n", "upto")).alias("r")).select("q", "r.*").collect()     # a row per query of the block
        for q, bin_, count, upto in hit:
            missing[q] = min(block.k - (upto - count), count)
            low[q] = int(low[q]) + (bin_ - 1) * width
        if width == 1:
            return low, missing
        width = -(-width // BINS)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
          scale: int = 256, block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of every query row,
    with every row but those of its own id; fewer rows: all. Ties go to the smaller id.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no
    part. Vectors of unequal length are compared as if filled with zeros; every finite
    component counts, and one (times ``scale``) or a score that no long can hold is an error. A repeated id keeps its rows as candidates; as a query it is asked once, with its first vector. No queries or an empty table:
    no rows. Other columns are not read. ``block`` bounds the queries held at once.
    """
    if k < 1 or block < 1:
        raise ValueError("k and block must be at least 1")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantized(F.col(vector_col), scale).alias("x"), is_query.alias("is_query"))
    rows = write_stage(rows.where("vec_id is not null and x is not null"), "topk-vectors")
    asked = write_stage(rows.where("is_query").groupBy("vec_id").agg(F.min("x").alias("x")), "topk-queries")
    schema, parts, after = "query_id long, vec_id long, score long", [], None
    candidates = rows.select("vec_id", "x")
    while True:
        left = asked if after is None else asked.where(F.col("vec_id") > after)
        got = left.orderBy("vec_id").limit(block).collect()         # a bounded block of the stated queries
        if not got:
            break
        after = got[-1]["vec_id"]
        dim = max(len(r["x"]) for r in got)
        m = np.zeros((len(got), max(1, dim)), np.int64)
        for i, r in enumerate(got):
            m[i, :len(r["x"])] = r["x"]
        b = _Block(np.array([r["vec_id"] for r in got], np.int64), m, k)
        low, missing = _kth_scores(candidates, b)
        parts.append(write_stage(candidates.mapInArrow(_winners(b, low, missing), schema), "topk-found"))
        if len(got) < block:
            break
    found = spark.createDataFrame([], schema)
    for p in parts:
        found = found.union(p)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
