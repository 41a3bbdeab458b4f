"""Binding of the benchmark tables to loan roles.

The driver ships TPC-H-like parquet tables, not loan files.  Each role a
loan operator needs is bound to one of them (see FIXTURES.md §3):

* loan            -> customer (``c_custkey``)
* monthly row     -> the customer's orders (one row per order date)
* servicer / MSA  -> ``c_mktsegment`` / ``c_nationkey``
* deeper panel    -> events by ``user_id``

The dirty variants inject the source data's defects (blank scores,
five-character dates, float-suffixed codes, unknown status codes) with
deterministic rules on the keys, so cleaning operators have work to do.
Every binding has a Spark builder and the same relation as SQL text for the
DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanpanel.operators.panel import PanelCols

PANEL_COLS = PanelCols(loan="loan", period="d", upb="upb", status="status", tiebreak="obs")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet) by name."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly rows: loan, obs (tie-break), d (period), month, upb (balance), status (0-4)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("loan"),
        F.col("o_orderkey").alias("obs"),
        F.col("o_orderdate").cast("date").alias("d"),
        F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"),
        F.col("o_totalprice").alias("upb"),
        (F.lit(5) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("status"),
    )


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deeper panel: a user's events as the loan's rows (many rows per day)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("loan"),
        F.col("event_id").alias("obs"),
        F.col("ts").cast("date").alias("d"),
        F.col("value").alias("upb"),
        F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 1).otherwise(0)
         .alias("status"),
    )


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan rows: loan, servicer, msa, score (300-850), balance."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("loan"),
        F.col("c_mktsegment").alias("servicer"),
        F.col("c_nationkey").alias("msa"),
        (F.lit(300) + (F.col("c_custkey") * 37) % 551).cast("int").alias("score"),
        F.col("c_acctbal").alias("balance"),
    )


def tail_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan rows with narrow scores, a few far above and below, and the catch-all servicer on every ninth loan."""
    k = F.col("loan")
    score = F.when(k % 211 == 5, 850).when(k % 197 == 3, 300).otherwise(640 + (k * 37) % 41).cast("int")
    servicer = F.when(k % 9 == 4, "Other servicers").otherwise(F.col("servicer"))
    return loans(spark, sf_dir).withColumns({"score": score, "servicer": servicer})


def loan_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel rows joined with their loan's servicer, MSA and score."""
    return panel(spark, sf_dir).join(loans(spark, sf_dir), "loan", "inner")


def dirty_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan rows as raw strings with the origination files' defects (FIXTURES.md §3)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    score = (F.when(k % 13 == 0, F.lit(None).cast("string"))
             .when(k % 11 == 0, F.lit("   "))
             .when(k % 17 == 0, F.lit("9"))
             .otherwise((F.lit(300) + (k * 37) % 551).cast("string")))
    first = (F.when(k % 19 == 0, F.lit("2006"))
             .when(k % 23 == 0, F.lit("200613"))
             .otherwise(F.concat(F.lit("2006"),
                                 F.substring(F.concat(F.lit("0"), (F.lit(1) + k % 9).cast("string")), 1, 2))))
    return c.select(
        k.alias("loan"),
        score.alias("score_raw"),
        first.alias("first_raw"),
        F.concat(((k * 7) % 100000).cast("string"), F.lit(".0")).alias("postal_raw"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.substring("c_mktsegment", 1, 1))
         .alias("channel_raw"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 3 == 0, F.lit("Y")).otherwise(F.lit("N"))
         .alias("flag_raw"),
        F.col("c_mktsegment").alias("servicer"),
        F.col("c_nationkey").alias("msa"),
        F.col("c_acctbal").alias("balance"),
    )


def dirty_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly rows as raw strings with the performance files' defects (FIXTURES.md §3)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = (F.when(k % 29 == 0, F.lit("R"))
              .when(k % 31 == 0, F.lit(None).cast("string"))
              .when(k % 37 == 0, F.lit("XX"))
              .otherwise((k % 6).cast("string")))
    zero = (F.when(k % 10 == 0, F.lit("1.0"))
            .when(k % 11 == 0, F.lit("9"))
            .when(k % 12 == 0, F.lit("15"))
            .otherwise(F.lit(None).cast("string")))
    return o.select(
        F.col("o_custkey").alias("loan"),
        k.alias("obs"),
        F.col("o_orderdate").cast("date").alias("d"),
        status.alias("status_raw"),
        zero.alias("zero_code_raw"),
        F.when(k % 8 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias("upb_raw"),
    )


# ---------------------------------------------------------------------------
# The same relations as SQL text for the DuckDB oracle (used as CTEs).
# ---------------------------------------------------------------------------

PANEL_SQL = """panel as (
  select o_custkey as loan, o_orderkey as obs, cast(o_orderdate as date) as d,
         cast(date_trunc('month', o_orderdate) as date) as month,
         o_totalprice as upb, 5 - cast(substr(o_orderpriority, 1, 1) as int) as status
  from orders)"""

EVENT_PANEL_SQL = """panel as (
  select user_id as loan, event_id as obs, cast(ts as date) as d, value as upb,
         case when event_type = 'error' then 2 when event_type = 'click' then 1 else 0 end as status
  from events)"""

LOANS_SQL = """loans as (
  select c_custkey as loan, c_mktsegment as servicer, c_nationkey as msa,
         cast(300 + (c_custkey * 37) % 551 as int) as score, c_acctbal as balance
  from customer)"""

TAIL_LOANS_SQL = """loans as (
  select c_custkey as loan, case when c_custkey % 9 = 4 then 'Other servicers' else c_mktsegment end as servicer,
         c_nationkey as msa,
         cast(case when c_custkey % 211 = 5 then 850 when c_custkey % 197 = 3 then 300
                   else 640 + (c_custkey * 37) % 41 end as int) as score, c_acctbal as balance
  from customer)"""

LOAN_MONTHS_SQL = """loan_months as (
  select p.*, l.servicer, l.msa, l.score, l.balance
  from panel p join loans l using (loan))"""

DIRTY_LOANS_SQL = """dirty_loans as (
  select c_custkey as loan,
         case when c_custkey % 13 = 0 then null when c_custkey % 11 = 0 then '   '
              when c_custkey % 17 = 0 then '9'
              else cast(300 + (c_custkey * 37) % 551 as varchar) end as score_raw,
         case when c_custkey % 19 = 0 then '2006' when c_custkey % 23 = 0 then '200613'
              else concat('2006', substr(concat('0', cast(1 + c_custkey % 9 as varchar)), 1, 2)) end as first_raw,
         concat(cast((c_custkey * 7) % 100000 as varchar), '.0') as postal_raw,
         case when c_custkey % 7 = 0 then null else substr(c_mktsegment, 1, 1) end as channel_raw,
         case when c_custkey % 5 = 0 then null when c_custkey % 3 = 0 then 'Y' else 'N' end as flag_raw,
         c_mktsegment as servicer, c_nationkey as msa, c_acctbal as balance
  from customer)"""

DIRTY_MONTHS_SQL = """dirty_months as (
  select o_custkey as loan, o_orderkey as obs, cast(o_orderdate as date) as d,
         case when o_orderkey % 29 = 0 then 'R' when o_orderkey % 31 = 0 then null
              when o_orderkey % 37 = 0 then 'XX' else cast(o_orderkey % 6 as varchar) end as status_raw,
         case when o_orderkey % 10 = 0 then '1.0' when o_orderkey % 11 = 0 then '9'
              when o_orderkey % 12 = 0 then '15' else null end as zero_code_raw,
         case when o_orderkey % 8 = 0 then null else o_totalprice end as upb_raw
  from orders)"""

_CTES = {
    "panel": PANEL_SQL,
    "loans": LOANS_SQL,
    "loan_months": LOAN_MONTHS_SQL,
    "dirty_loans": DIRTY_LOANS_SQL,
    "dirty_months": DIRTY_MONTHS_SQL,
}
_DEPENDS = {"loan_months": ["panel", "loans"]}


def with_ctes(*names: str) -> str:
    """``with`` clause holding the named bindings (and what they depend on)."""
    order: list[str] = []
    for n in names:
        for dep in _DEPENDS.get(n, []) + [n]:
            if dep not in order:
                order.append(dep)
    return "with " + ",\n".join(_CTES[n] for n in order)
