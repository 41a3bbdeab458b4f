"""Packing along a space-filling curve: neighbouring documents share sequences, with no padding between.

Each document's hashed token counts are projected to a few dimensions; its place on the Hilbert curve
through that space is its sort key. The documents are range-sorted by the key, laid end to end, and the
line is cut every ``length`` tokens, so only the last sequence is short.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.llm.common import mix, shared_tokenizer, write_stage

DIMS, BITS = 3, 12          # the curve's dimensions, and bits of each


def projection(size: int, dims: int = DIMS, seed: int = 9) -> np.ndarray:
    """A fixed pseudo-random direction for each token id, near normal (sums of four uniforms)."""
    with np.errstate(over="ignore"):
        u = [mix(np.arange(size * dims, dtype=np.uint64) * np.uint64(4) + np.uint64((seed << 40) + k)) / 2.0 ** 64 for k in range(4)]
    return ((sum(u) - 2.0) * math.sqrt(3.0)).reshape(size, dims)


def curve_cells(ids: np.ndarray, directions: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A document's cell: its damped token counts, as a unit vector, projected and cut to ``bits`` bits.
    The projection of a unit vector is near standard normal, so its normal quantile fills the cells evenly."""
    if not len(ids):
        return np.zeros(directions.shape[1], np.int64)
    tokens, counts = np.unique(ids, return_counts=True)
    weights = np.log1p(counts)
    p = weights @ directions[tokens] / math.sqrt(float(weights @ weights))
    return np.array([min((1 << bits) - 1, int((0.5 + 0.5 * math.erf(x / math.sqrt(2))) * (1 << bits))) for x in p], np.int64)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of ``cells`` (rows x dims, below 2**bits), by undoing the
    curve's turns from the coarsest bit down and reading the bits off in Gray code."""
    x = [c.astype(np.int64).copy() for c in cells.T]
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            turned = (x[i] >> b) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ flip) >> b) & 1)
    return key


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few documents' ids are held at once. What Arrow keeps of
    a batch that is done with goes back to the system."""
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))
        pa.default_memory_pool().release_unused()


def _encode(path: str, end_id: int, size: int, cached_pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, directions = shared_tokenizer(path, False, cached_pieces), projection(size)
        for b in small(batches):
            ids = [np.append(tok.encode(t.as_py()), np.uint16(end_id)) for t in b.column(2)]
            keys = hilbert_key(np.array([curve_cells(x[:-1], directions) for x in ids]).reshape(len(ids), DIMS))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(keys, pa.int64()),
                 pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "key", "n", "curve", "ids"])
    return run


def _pieces(length: int):
    names = ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for b in small(batches):
            docs, rows = [], []                 # row of the batch, and the piece
            for k, (blob, copies, place) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]))):
                ids = np.frombuffer(blob, np.uint16).astype("<u4")
                n = len(ids)
                for copy in range(copies):
                    at, start = place + copy * n, 0
                    while start < n:
                        end = min(n, start + length - (at + start) % length)
                        docs.append(k)
                        rows.append((copy, start, end - start, zlib.crc32(ids[start:end]), n, (at + start) // length, (at + start) % length))
                        start = end
                    if len(rows) >= 10_000:
                        yield emit(b, docs, rows)
                        docs, rows = [], []
            if rows:
                yield emit(b, docs, rows)

    def emit(b, docs, rows):
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs)), *(pa.array(c, pa.int64()) for c in zip(*rows))], names)
    return run


def laid_out(sizes: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """``sizes`` with a column ``at``: the sum of ``size`` over the rows before it in ``order``, which
    must tell rows apart. Range partitions are summed, and each partition's rows on top of that."""
    parts = write_stage(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    totals = parts.groupBy("part").agg(F.sum(size).alias("total"))          # a row per partition
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum(size).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return parts.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("at", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = 2048,
         end_id: int = 1, vocabulary: int = 1 << 16, cached_pieces: int = 600_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, copy) of every piece.

    A document is its text's ids and then ``end_id``; a null text is empty, so its document is the end id
    alone. Each id lies in one piece; every sequence but the last is full. Repeated rows follow each other
    as copies 0, 1, ...; a null id is a row like any other. An empty table returns no rows; other columns
    are not read. Ids must be below 65,536, as both public vocabularies' are. ``cached_pieces`` bounds the
    pieces whose ids a worker remembers (some 200 bytes each); it changes no result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key"), F.col(text_col).alias("text"))
    coded = write_stage(rows.mapInArrow(_encode(tokenizer or default_tokenizer(), end_id, vocabulary, cached_pieces),
                                        f"doc_id {kind}, key binary, n long, curve long, ids binary"), "pack-ids")
    sizes = coded.groupBy("doc_id", "key").agg(F.first("curve").alias("curve"), F.sum("n").alias("total"))
    placed = write_stage(laid_out(sizes, ["curve", "doc_id", "key"], "total", "pack-order").select(
        F.col("doc_id").alias("id2"), F.col("key").alias("key2"), "at"), "pack-places")
    once = coded.groupBy("doc_id", "key").agg(F.first("ids").alias("ids"), F.count(F.lit(1)).alias("copies"))
    joined = once.join(placed, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")))
    schema = f"doc_id {kind}, copy long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return joined.select("doc_id", "ids", "copies", "at").mapInArrow(_pieces(length), schema).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "copy")
