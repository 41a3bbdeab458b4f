"""Delimited loan files, census extracts, CSV sinks and stage tables.

Loan files are pipe-delimited text without a header.  They are read as
lines and split with a built-in expression, so the bad-line policy is
exact and stays inside one scan:

* ``bad_lines="skip"``  - lines with more fields than columns are dropped
  (short lines are kept, missing fields NULL), as the source's loader does;
* ``bad_lines="error"`` - a line with too many fields fails the job
  (``raise_error`` evaluated lazily in the scan, no extra pass);
* ``bad_lines="keep"``  - extra fields are ignored.

Every record is kept (the file has no header line).  Types come from an
explicit cast spec (``try_cast``: a bad value becomes NULL, never an
error) and month codes from a date spec.  Globs and directories read all
their files in one scan; file choice by a period token keeps only the
matching paths at listing time, so other files are never opened.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanpanel import schema as S
from loanpanel.functions.exprs import parse_yyyymm
from loanpanel.session import ensure_checkpoint_dir

SAMPLE_ROWS = 10_000  # the source's 'sample' row count


def staging_dir(spark: SparkSession, name: str = "stage") -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/loanpanel-{name}-{uuid.uuid4().hex[:12]}"


def load_delimited(spark: SparkSession, path: str | list[str], columns: list[str], sep: str = "|",
                   bad_lines: str = "skip", nrows: int | None = None,
                   col_types: Mapping[str, str] | None = None,
                   date_formats: Mapping[str, str] | None = None,
                   period_tokens: Iterable[str] | None = None,
                   keep_file_name: bool = False) -> DataFrame:
    """Read delimited text into named, typed columns."""
    if bad_lines not in ("skip", "error", "keep"):
        raise ValueError("bad_lines must be skip, error or keep")
    paths = [path] if isinstance(path, str) else list(path)
    if period_tokens:
        # A5: choose files by a token in their path at listing time, so only
        # the chosen files are ever scanned
        toks = list(period_tokens)
        paths = [f for f in list_files(spark, paths) if any(t in f for t in toks)]
    rows = _split_lines(spark, paths, len(columns), sep, bad_lines)
    if nrows is not None:
        rows = _first_rows(spark, paths, nrows, lambda some: _split_lines(spark, some, len(columns), sep, bad_lines))
    out = rows.select(*[F.nullif(F.get(F.col("__f"), i), F.lit("")).alias(c) for i, c in enumerate(columns)],
                      *(["__file"] if keep_file_name else []))
    if col_types:
        out = cast_by_spec(out, col_types)
    if date_formats:
        out = parse_dates_by_spec(out, date_formats, shape_filter=True)
    return out


def _split_lines(spark: SparkSession, paths: list[str], n: int, sep: str, bad_lines: str) -> DataFrame:
    """Fields (``__f``), file and place of every record of ``paths``: blank lines are no records, and
    lines of more than ``n`` fields follow the bad-line policy. No paths: no rows, same columns."""
    if paths:
        raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("__file"),
                                            F.col("_metadata.file_block_start").alias("__block"))
    else:
        raw = spark.createDataFrame([], "value string, __file string, __block long")
    # a block of a file is read by one task in line order, so the id orders the lines within it
    rows = raw.withColumn("__line", F.monotonically_increasing_id()).where(F.length("value") > 0) \
              .withColumn("__f", F.split(F.col("value"), _regex_escape(sep), -1))
    too_long = F.size("__f") > n
    if bad_lines == "skip":
        rows = rows.where(~too_long)
    elif bad_lines == "error":
        rows = rows.withColumn("__f", F.when(too_long, F.raise_error(
            F.concat(F.lit(f"line has more than {n} fields: "), F.col("value")))).otherwise(F.col("__f")))
    return rows


def _first_rows(spark: SparkSession, paths: list[str], nrows: int, read) -> DataFrame:
    """A3: the first ``nrows`` records by file name and place in the file. The files are opened in that
    order, a few more each time, until they hold enough; each task keeps its first ``nrows`` only."""
    files, opened = list_files(spark, paths), 1
    while opened < len(files) and read(files[:opened]).limit(nrows).count() < nrows:
        opened *= 4
    return read(files[:opened]).orderBy("__file", "__block", "__line").limit(nrows)


def list_files(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """Expand globs and directories into data files (hidden and ``_`` files skipped),
    through the Hadoop file system the scan itself uses."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out: list[str] = []

    def walk(status):
        name = status.getPath().getName()
        if name.startswith((".", "_")):
            return
        if status.isDirectory():
            fs = status.getPath().getFileSystem(conf)
            for child in fs.listStatus(status.getPath()):
                walk(child)
        else:
            out.append(status.getPath().toString())

    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        for st in (fs.globStatus(hp) or []):
            walk(st)
    return sorted(out)


def _regex_escape(sep: str) -> str:
    return "".join("\\" + ch if ch in ".^$*+?()[]{}|\\" else ch for ch in sep)


def cast_by_spec(df: DataFrame, col_types: Mapping[str, str]) -> DataFrame:
    """A10: per-column type change; a value that does not parse becomes NULL."""
    return df.withColumns({c: F.trim(F.col(c).cast("string")).try_cast(t)
                           for c, t in col_types.items() if c in df.columns})


def parse_dates_by_spec(df: DataFrame, date_formats: Mapping[str, str], shape_filter: bool = True) -> DataFrame:
    """Parse date columns; for ``yyyyMM`` codes optionally keep only values
    of 5-6 characters (the loan loader's rule)."""
    out = df
    for c, fmt in date_formats.items():
        if c not in out.columns:
            continue
        if fmt == "yyyyMM":
            if shape_filter:
                out = out.where(F.length(F.trim(F.col(c).cast("string"))).isin(5, 6))
            out = out.withColumn(c, parse_yyyymm(c))
        else:
            out = out.withColumn(c, F.try_to_date(F.col(c).cast("string"), fmt))
    return out


def load_origination(spark: SparkSession, path: str, sample: bool = False, bad_lines: str = "skip",
                     clean: bool = True) -> DataFrame:
    """Origination file(s) -> typed rows (a directory reads every ``*.txt``)."""
    from loanpanel.operators.clean import clean_scores
    src = _txt_glob(path)
    df = load_delimited(spark, src, S.ORIGINATION_COLUMNS, bad_lines=bad_lines,
                        nrows=SAMPLE_ROWS if sample else None)
    if clean:
        df = clean_scores(df)
    df = cast_by_spec(df, {k: v for k, v in S.ORIGINATION_TYPES.items() if k != "creditScore"})
    return parse_dates_by_spec(df, {"firstPaymentDate": "yyyyMM"}, shape_filter=True) \
        .withColumn("maturityDate", parse_yyyymm("maturityDate"))


def load_monthly(spark: SparkSession, path: str, sample: bool = False, bad_lines: str = "skip") -> DataFrame:
    """Monthly performance file(s) -> typed rows, the reporting period parsed
    (full mode reads the whole directory).  Status and code columns stay text for the prep;
    a number that cannot be read becomes NULL."""
    src = _txt_glob(path)
    df = load_delimited(spark, src, S.MONTHLY_COLUMNS, bad_lines=bad_lines,
                        nrows=SAMPLE_ROWS if sample else None)
    return parse_dates_by_spec(cast_by_spec(df, S.MONTHLY_TYPES), S.MONTHLY_DATES, shape_filter=False)


def _txt_glob(path: str) -> str:
    if path.endswith(".txt") or "*" in path:
        return path
    return path.rstrip("/") + "/*.txt"


def load_census(spark: SparkSession, path: str, filename: str, nrows: int | str | None = None,
                dictionary_path: str | None = None, col_types: Mapping[str, str] | None = None,
                date_formats: Mapping[str, str] | None = None) -> DataFrame:
    """Headed census CSV (``.csv`` added when missing), renamed through a
    Field -> Renamed dictionary, cast and date-parsed. All rows, unless ``nrows`` asks for the first
    few (``"sample"``: the source's 10,000)."""
    if not filename.endswith(".csv"):
        filename += ".csv"
    df = spark.read.option("header", True).csv(os.path.join(path, filename))
    if nrows is not None:
        n = SAMPLE_ROWS if nrows == "sample" else int(nrows)
        df = df.withColumn("__line", F.monotonically_increasing_id()).orderBy("__line").limit(n).drop("__line")
    if dictionary_path:
        df = rename_by_dictionary(df, spark.read.option("header", True).csv(dictionary_path))
    if col_types:
        df = cast_by_spec(df, col_types)
    if date_formats:
        df = parse_dates_by_spec(df, date_formats, shape_filter=False)
    return df


def rename_by_dictionary(df: DataFrame, dictionary: DataFrame, field: str = "Field",
                         renamed: str = "Renamed") -> DataFrame:
    """Bulk rename from a lookup table (the dictionary is one row per
    column of ``df``, so collecting it is bounded by the schema width)."""
    wanted = set(df.columns)
    pairs = dictionary.where(F.col(field).isin(list(wanted))).select(field, renamed).collect()
    return df.withColumnsRenamed({r[0]: r[1] for r in pairs if r[1]})


def write_delimited(df: DataFrame, path: str, sep: str = "|", header: bool = False,
                    mode: str = "overwrite") -> str:
    """CSV / delimited sink."""
    df.write.mode(mode).option("sep", sep).option("header", header).csv(path)
    return path


def write_stage(df: DataFrame, path: str, partition_by: Iterable[str] | None = None,
                mode: str = "overwrite") -> str:
    """Materialise a stage between pipeline steps as Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """Read a stage back."""
    return spark.read.parquet(path)
