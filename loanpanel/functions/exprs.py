"""Column expressions shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen; nothing is a Python UDF.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Division that yields NULL (not an ANSI error, not inf) on a zero divisor."""
    return F.try_divide(col(num), F.nullif(col(den), F.lit(0)))


def rnd(c: ColumnOrName, digits: int) -> Column:
    """Round a double to ``digits`` decimals for comparison across engines.

    Computed as round(x * 10^d) / 10^d on the double itself (half away from
    zero on the scaled value), which is the arithmetic SQL engines such as
    DuckDB use; Spark's own ``round(x, d)`` rounds the exact decimal value
    of the double instead, and the two disagree on values within one ulp of
    a half."""
    scale = float(10 ** digits)
    return F.round(col(c).cast("double") * F.lit(scale), 0) / F.lit(scale)


def month_start(c: ColumnOrName) -> Column:
    """First day of the month as a DATE (``date_trunc`` would give a zoned timestamp)."""
    return F.trunc(col(c).cast("date"), "MM")


def month_bucket(c: ColumnOrName) -> Column:
    """Date -> 'YYYY-MM' (the monthly period as a string)."""
    return F.date_format(col(c), "yyyy-MM")


def parse_yyyymm(c: ColumnOrName, pad_short: bool = True) -> Column:
    """Parse a ``yyyyMM`` month code into a DATE, NULL when it is not one.

    A five-character code such as ``20061`` means January 2006; it is padded
    to ``200601`` first (the month digits are left-padded).  A trailing ``.0``
    (codes that went through a float) is removed.
    """
    s = F.trim(F.regexp_replace(col(c).cast("string"), r"\.0$", ""))
    if pad_short:
        s = F.when(F.length(s) == 5,
                   F.concat(F.substring(s, 1, 4), F.lpad(F.substring(s, 5, 1), 2, "0"))
                   ).otherwise(s)
    return F.when(F.length(s) == 6, F.try_to_date(s, "yyyyMM"))


def strip_float_suffix(c: ColumnOrName) -> Column:
    """Remove '.0' from codes that went through a float (every occurrence, as the source does)."""
    return F.replace(col(c).cast("string"), F.lit(".0"), F.lit(""))


def zero_pad(c: ColumnOrName, width: int) -> Column:
    """Left-pad with zeros to ``width`` without truncating longer values (zfill)."""
    s = col(c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def yes_no_flag(c: ColumnOrName, yes_values=("Y",)) -> Column:
    """1 for any of ``yes_values``, 0 for anything else (including NULL)."""
    return F.when(col(c).isin(list(yes_values)), F.lit(1)).otherwise(F.lit(0))


def delinquency_number(c: ColumnOrName) -> Column:
    """Delinquency status code -> number; 'R' -> 7, NULL/unknown codes -> 0."""
    s = F.trim(col(c).cast("string"))
    return F.coalesce((F.replace(s, F.lit("R"), F.lit("7"))).try_cast("double"), F.lit(0.0))


# Abramowitz & Stegun 26.2.17 normal-CDF approximation (|error| < 7.5e-8).
NCDF_P = 0.2316419
NCDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_upper_tail(z: Column) -> Column:
    """P(Z > |z|) for a standard normal Z."""
    a = F.abs(z)
    t = 1.0 / (1.0 + NCDF_P * a)
    poly = F.lit(0.0)
    for b in reversed(NCDF_B):
        poly = (poly + b) * t
    return F.exp(-a * a / 2.0) / math.sqrt(2 * math.pi) * poly


# Gauss-Legendre nodes and weights on [0, 1]
_NODES = [((x + 1) / 2, w / 2) for x, w in zip(*np.polynomial.legendre.leggauss(52))]
# 1 / z^k terms of gamma(z + 1/2) / (gamma(z) sqrt(z))
_HALF_STEP = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304)
_SHIFT = 32


def gamma_half_step(z: Column) -> Column:
    """gamma(z + 1/2) / gamma(z) for z > 0: the asymptotic series at z + 32, brought back by the recurrence."""
    far = z + _SHIFT
    series = F.lit(0.0)
    for c in reversed(_HALF_STEP):
        series = series / far + c
    back = F.lit(1.0)
    for k in range(_SHIFT):
        back = back * ((z + k) / (z + (k + 0.5)))
    return F.sqrt(far) * series * back


def two_sided_t_pvalue(t: ColumnOrName, dof: ColumnOrName) -> Column:
    """Two-sided p-value of Student's t, no UDF; one formula and the same work for all degrees of freedom v.

    With t = sqrt(v) sinh(u) the density is proportional to cosh(u)^-v, so p is the integral of
    cosh(u)^-v from u0 = asinh(|t| / sqrt(v)) over that from 0, which is sqrt(pi) gamma(v / 2) /
    (2 gamma((v + 1) / 2)).  The former is taken up to where the integrand has fallen by e^-40, at
    u = u0 + range * s^2 for fixed nodes s of [0, 1].
    """
    t = col(t).cast("double")
    v = col(dof).cast("double")
    nodes = F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(float(w)).alias("w")) for s, w in _NODES])

    def reach(log_cosh):                        # the u of a given ln cosh(u)
        return log_cosh + F.log1p(F.sqrt(-F.expm1(-2 * log_cosh)))

    first = F.log1p(F.least(t * t / v, F.lit(1e250))) / 2
    ends = F.struct(reach(first).alias("start"), (reach(first + 40 / v) - reach(first)).alias("width"), first.alias("first"), v.alias("v"))

    def over(x):                                # an array of one struct: its fields are worked out once, not per node
        def add(total, node):
            height = F.sinh(x["start"] + x["width"] * node["s"] * node["s"])
            return total + node["w"] * node["s"] * F.exp(-x["v"] * (F.log1p(height * height) / 2 - x["first"]))
        return 2 * x["width"] * F.aggregate(nodes, F.lit(0.0), add)

    tail = F.transform(F.array(ends), over)[0]          # relative to the integrand at u0
    p = F.exp(-v * first) * tail * gamma_half_step(v / 2) * (2 / math.sqrt(math.pi))
    return F.when((v >= 1) & t.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def t_pvalue_sql(t: str, dof: str) -> str:
    """The p-value as DuckDB SQL text for the oracle, by the finite sums for integer degrees of freedom
    (Abramowitz & Stegun 26.7.3, 26.7.4)."""
    th = f"atan(abs({t}) / sqrt({dof}))"
    odd_sum = (f"coalesce(list_sum(list_transform(range(0, cast(floor(({dof} - 3) / 2) as bigint) + 1), "
               f"lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) "
               f"* pow(cos({th}), 2 * k + 1))), 0)")
    even_sum = (f"coalesce(list_sum(list_transform(range(0, cast(floor(({dof} - 2) / 2) as bigint) + 1), "
                f"lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * ln(2)) "
                f"* pow(cos({th}), 2 * k))), 0)")
    return (f"case when {dof} >= 1 then least(greatest(case when {dof} % 2 = 1 "
            f"then 1 - (2 / pi()) * ({th} + sin({th}) * {odd_sum}) "
            f"else 1 - sin({th}) * {even_sum} end, 0.0), 1.0) end")
