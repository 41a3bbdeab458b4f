"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the
shared folder and reads again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanpanel.llm import decontaminate, mil, packing, secrets, simhash
from loanpanel.llm.common import write_stage

#: a document goes when its quality score is below this: surely bad, not merely doubtful
LEAST_QUALITY = 0.2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier does not reject; it is fitted on labelled rows of
    ``docs`` other than the held-out ones of the quality query. Null and empty texts are scored too."""
    fitted_on = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = mil.fit_quality(docs, _table(spark, sf_dir, "labels"), fitted_on)
    return mil.keep_quality(docs, model, LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that of the smallest doc_id (of rows that repeat
    it, one). A row without a doc_id stays only where no row of its group has one."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which an overlap with a benchmark item is verified."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found in a text; all documents stay."""
    return secrets.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences, one row per piece. Workers still hold memory of the stages
    before, so fewer pieces are remembered than by default."""
    return packing.pack(docs, cached_pieces=200_000)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated),
          ("redacted", redacted), ("packed", packed)]

#: SQL cannot express the stages (a fitted network, 64-bit hashes, spaced seeds, a tokenizer). The tests
#: hold the operators against brute-force versions, and of the stages' own functions ``keep_one``, and
#: ``drop_contaminated`` for short items; a test of the whole pipeline is open.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
