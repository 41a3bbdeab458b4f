"""Encodings of loan codes and flags.

Static code maps are literal ``when`` chains or ``create_map`` lookups;
a dynamic one-hot encoding needs the set of observed values on the driver, as
each becomes a column: one bounded ``distinct``, sorted so the schema is
stable; callers can pass a fixed list instead.  Label encoding numbers the
values in a distributed dictionary and joins it back, for any number of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanpanel.functions.exprs import (
    delinquency_number,
    month_bucket,
    parse_yyyymm,
    strip_float_suffix,
    yes_no_flag,
    zero_pad,
)
from loanpanel.operators.panel import DELINQUENCY_BUCKETS
from loanpanel.session import cut_lineage
from loanpanel.sources.bins import dense_index

# Zero-balance codes (after padding to two digits) and their names.
ZERO_BALANCE_CODES = {
    "00": "unknown",
    "01": "prepaid_matured",
    "03": "foreclosure_alternative",
    "06": "repurchase",
    "09": "REO_disposition",
}
ZERO_BALANCE_UNMAPPED = "00"

# Static one-hot code map of the origination prep (code -> column suffix).
PRODUCT_TYPE_CODES = {
    "CO": "Condo", "LH": "Leasehold", "PU": "PUD", "MH": "Manufactured Housing",
    "SF": "1_4_feeSimple", "CP": "co_op", " ": "Unknown",
}
# Static one-hot maps of the older preps (code -> column name).
LOAN_PURPOSE_NAMES = {"P": "purchaseIntent", "C": "cashOutRefinanceIntent", "N": "noCashOutRefinanceIntent"}
PROPERTY_TYPE_NAMES = {
    "CO": "condo", "LH": "leasehold", "PU": "PUD", "MH": "manufacturedHousing",
    "SF": "14feeSimple", "CP": "co_op",
}
OCCUPANCY_NAMES = {"O": "ownerOccupied", "I": "investmentOccupied", "S": "secondHomeOccupied"}
CHANNEL_NAMES = {"R": "retailChannel", "B": "brokerChannel", "C": "correspondentChannel", "T": "tpoChannel"}
ZERO_BALANCE_NAMES = {1: "voluntaryPayoff", 3: "foreclosureAlternative", 6: "repurchasePreDisposition",
                      9: "reoDisposition"}


def status_to_number(df: DataFrame, column: str = "currLoanDelinqStatus",
                     out: str | None = None) -> DataFrame:
    """D4: 'R' -> 7, cast to double, NULL and unknown codes -> 0."""
    return df.withColumn(out or column, delinquency_number(column))


def serious_delinquency(status: str | Column = "currLoanDelinqStatus", threshold: int = 2) -> Column:
    """1 when the numeric status is at least ``threshold`` (R counts as 7)."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s >= threshold, 1).otherwise(0)


def delinquency_bucket(status: str | Column = "currLoanDelinqStatus") -> Column:
    """Numeric status -> days-past-due bucket label (7 and above -> last label)."""
    s = F.col(status) if isinstance(status, str) else status
    m = F.create_map(*[x for k, v in DELINQUENCY_BUCKETS.items() for x in (F.lit(k), F.lit(v))])
    return m[F.least(s.cast("int"), F.lit(max(DELINQUENCY_BUCKETS)))]


def flag_map(df: DataFrame, columns: Iterable[str], yes_values=("Y",)) -> DataFrame:
    """Y/N-style flags -> 1/0 (anything else -> 0)."""
    return df.withColumns({c: yes_no_flag(c, yes_values) for c in columns})


def decode_zero_balance(column: str = "zeroBalanceCode") -> Column:
    """Strip a float suffix, pad to two digits, map to the code name;
    anything unmapped (including NULL) -> '00'."""
    code = zero_pad(strip_float_suffix(column), 2)
    m = F.create_map(*[x for k, v in ZERO_BALANCE_CODES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[code], F.lit(ZERO_BALANCE_UNMAPPED))


def one_hot_static(df: DataFrame, column: str, codes: Mapping, prefix: str | None = None,
                   trim: bool = False, named: bool = False, drop_source: bool = False) -> DataFrame:
    """One 0/1 column per entry of a fixed code map, named
    ``<prefix>_<name>`` or, with ``named``, just ``<name>``."""
    prefix = prefix or column
    v = F.trim(F.col(column)) if trim else F.col(column)
    out = df.withColumns({(name if named else f"{prefix}_{name}"): F.when(v == F.lit(code), 1).otherwise(0)
                          for code, name in codes.items()})
    return out.drop(column) if drop_source else out


MAX_CODES = 10_000  # a code column with more distinct values is not a code column


def observed_values(df: DataFrame, column: str, max_values: int = MAX_CODES) -> list:
    """Sorted distinct non-NULL values of a code column (one aggregate).

    At most ``max_values + 1`` values ever reach the driver; a column with
    more is refused rather than collected, as each value becomes a column."""
    vals = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct()
            .limit(max_values + 1).collect()]
    if len(vals) > max_values:
        raise ValueError(f"{column} has more than {max_values} distinct values; pass the code list")
    return sorted(vals)


def observed_values_of(df: DataFrame, columns: Iterable[str], max_values: int = MAX_CODES) -> dict[str, list]:
    """:func:`observed_values` of several string columns, in one job."""
    cols = list(columns)
    if not cols:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in cols])).alias("p")
    found = (df.select(pairs).select("p.*").where(F.col("value").isNotNull()).distinct()
             .limit(len(cols) * max_values + 1).collect())
    out = {c: sorted(r["value"] for r in found if r["name"] == c) for c in cols}
    for c, vals in out.items():
        if len(vals) > max_values:
            raise ValueError(f"{c} has more than {max_values} distinct values; pass the code list")
    return out


def one_hot_dynamic(df: DataFrame, column: str, values: Iterable | None = None,
                    prefix: str | None = None) -> DataFrame:
    """``<prefix>_<value>`` 0/1 column for each observed value, sorted."""
    prefix = prefix or column
    vals = list(values) if values is not None else observed_values(df, column)
    return df.withColumns({f"{prefix}_{v}": F.when(F.col(column) == F.lit(v), 1).otherwise(0)
                           for v in vals})


def label_dictionary(df: DataFrame, column: str, label: str = "label") -> DataFrame:
    """(column, label): the distinct non-NULL values in order, numbered 0, 1, 2, ...

    The values are range-partitioned and numbered by partition offsets, so a column may have any number of
    them; the table is staged and never passes through the driver."""
    return cut_lineage(dense_index(df.where(F.col(column).isNotNull()), column, label))


def label_encode(df: DataFrame, column: str, out: str | None = None, fill: str | None = None) -> DataFrame:
    """Sorted distinct values -> 0..k-1; a NULL that ``fill`` does not replace becomes k.

    The rows meet the dictionary in a join of two plain shuffles, so AQE broadcasts a small dictionary by
    its measured size and splits a value that holds very many rows."""
    src = df.fillna({column: fill}) if fill is not None else df
    tmp = f"__{column}_label"
    labels = label_dictionary(src, column, tmp)
    k = labels.agg(F.count(F.lit(1))).scalar()
    value = F.coalesce(F.col(tmp), k).cast("int")
    keep = [value.alias(c) if c == (out or column) else F.col(f"`{c}`") for c in src.columns]
    joined = src.join(labels, column, "left")
    return joined.select(*keep, *([value.alias(out)] if out and out not in src.columns else []))


def strip_and_pad(df: DataFrame, column: str, width: int | None = None) -> DataFrame:
    """Remove '.0' and (optionally) zero-pad to ``width``."""
    v = strip_float_suffix(column)
    return df.withColumn(column, zero_pad(v, width) if width else v)


def blank_to_zero(column: str, replacements=(("   ", "0"), ("000", "0"))) -> Column:
    """Blank / all-zero codes -> '0' (each blank becomes a zero), cast to double."""
    s = F.col(column).cast("string")
    for old, new in replacements:
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.replace(s, F.lit(" "), F.lit("0"))
    return s.try_cast("double")


def sentinel_indicators(df: DataFrame, column: str, sentinels: Mapping[str, str]) -> DataFrame:
    """One 0/1 column per sentinel value (tests the source column)."""
    return df.withColumns({f"{column}_{name}": F.when(F.col(column) == F.lit(code), 1).otherwise(0)
                           for code, name in sentinels.items()})


def month_parts(df: DataFrame, column: str, parse: bool = True) -> DataFrame:
    """Parsed month date, 'YYYY-MM' bucket and year."""
    d = parse_yyyymm(column) if parse else F.col(column).cast("date")
    out = df.withColumn(f"{column}_date", d)
    return (out.withColumn(f"{column}_month", month_bucket(f"{column}_date"))
               .withColumn(f"{column}_year", F.year(f"{column}_date")))


def abs_deviation(df: DataFrame, columns: Iterable[str], suffix: str = "_stzd") -> DataFrame:
    """``abs(x - mean(x))`` as ``x_stzd``, source column dropped.

    The means come from one single-row aggregate and are inlined as
    literals, so no join (and no cross join) is needed."""
    cols = list(columns)
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    out = df.withColumns({f"{c}{suffix}": F.abs(F.col(c) - F.lit(means[c]).cast("double")) for c in cols})
    return out.drop(*cols)


def add_constant(df: DataFrame, name: str = "const") -> DataFrame:
    """Intercept column."""
    return df.withColumn(name, F.lit(1.0))
