"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments; within each segment the small Hamming ball (every single flipped
bit) is enumerated, the rest of the fingerprint staying as it is. The probed code, segment and rest
together, is the table's key. Two fingerprints at distance 2 or less meet at a code half-way between
them, so one look-up finds every link, and a code can be reached from 65 fingerprints only, however
many documents a group of near copies holds: no bucket grows, and no group is paired off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.llm.common import numbered, utf8, write_stage
from loanpanel.llm.components import connected_components

BITS, SEGMENTS, SEED = 64, 4, 42


def simhash(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of a whole text, as a signed 64-bit integer; no words: zero."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; other columns are not read."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, f"doc_id {kind}, fp long")


def _ball_masks() -> list[int]:
    width = BITS // SEGMENTS
    masks = [0]
    for segment in range(SEGMENTS):
        for bit in range(width):
            m = 1 << (segment * width + bit)
            masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def fingerprint_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of ``fp`` at ``max_bits`` or fewer bits.

    Not every pair is returned: within a code's bucket each fingerprint is linked to the smallest one,
    and the complete distance of the two is verified.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    fps = fps.select("fp").distinct()
    if max_bits == 0:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where(F.lit(False))
    probes = fps.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in _ball_masks()])).alias("code"))
    if max_bits == 1:       # table of the fingerprints themselves, looked up by every code of the balls
        return (probes.join(fps.select(F.col("fp").alias("v")), F.col("code") == F.col("v"))
                .where("fp > v").select(F.col("fp").alias("u"), "v"))
    least = probes.withColumn("v", F.min("fp").over(Window.partitionBy("code"))).where("fp <> v")
    return (least.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= max_bits)
            .select(F.col("fp").alias("u"), "v").distinct())


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _groups(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, least_id, n) of every fingerprint in ``rows`` (doc_id, fp); root names its group."""
    by_fp = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    roots = connected_components(fingerprint_links(by_fp, max_bits))
    rooted = by_fp.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", "n", F.coalesce("root", "fp").alias("root"))
    return write_stage(rooted, "simhash-root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_members): every row's near-duplicate group.

    component_id is the smallest id reachable over links of ``max_bits`` or fewer differing bits.
    Null and wordless texts have fingerprint zero and are linked like any other. A null id keeps its
    row and is never a component's id (unless all ids there are null). Repeated rows each return one
    row. An empty table returns none. Extra columns are ignored.
    """
    rows = write_stage(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    rooted = _groups(rows, max_bits)
    groups = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("n").alias("n_members"))
    table = write_stage(rooted.select("fp", "root").join(write_stage(groups, "simhash-group"), "root").drop("root"), "simhash-class")
    return rows.join(table, "fp").select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id", "n_members")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate group: the one of the smallest id (a null id
    comes after all others), of rows that repeat it the one of the smallest fingerprint, then of the
    smallest text digest, and of rows equal in all three, one. Columns keep their names, whatever these are."""
    @F.udf("long", useArrow=True)
    def fingerprint(text):
        return simhash(text, shingle)

    names = docs.columns
    key, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    digest = F.coalesce(F.sha2(F.col(text), 256), F.lit(""))
    marked = numbered(docs).withColumn("fp", fingerprint(F.col(text))).withColumn("digest", digest)
    rows = write_stage(marked.select(F.col(key).alias("doc_id"), "fp", "digest"), "simhash-fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "digest")).alias("first")
    # the first row of each fingerprint, then of each group: no group's rows come to one task
    by_fp = rows.groupBy("fp").agg(first).select("fp", "first")
    keepers = (by_fp.join(_groups(rows, max_bits).select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
               .select("first.doc_id", "first.fp", "first.digest"))
    keepers = write_stage(keepers, "simhash-keep")
    on = F.col(f"d.{key}").eqNullSafe(F.col("k.doc_id")) & (F.col("d.fp") == F.col("k.fp")) & (F.col("d.digest") == F.col("k.digest"))
    kept = marked.alias("d").join(keepers.alias("k"), on, "left_semi").dropDuplicates([key, "fp", "digest"])
    return kept.drop("fp", "digest").toDF(*names)
