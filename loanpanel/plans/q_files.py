"""File-layer queries (A1-A15): the bound tables are written out in the loan
files' formats under the shared checkpoint folder and read back through the
loaders, so each query checks a full write -> scan round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanpanel.functions.exprs import rnd
from loanpanel.plans import driver_tables as T
from loanpanel.plans.registry import query
from loanpanel.sources import bins as B
from loanpanel.sources import delimited as D

SCAN_COLUMNS = ["obs", "loanSeqNumber", "mthlyRepPeriod", "currUPB", "currLoanDelinqStatus"]
LONG_EVERY, SHORT_EVERY = 97, 89   # lines with an extra field / a missing last field


def _monthly_line():
    """An order as a pipe-delimited monthly line; every 97th line has an extra
    field (a long line) and every 89th lacks its last field (a short line)."""
    k = F.col("o_orderkey")
    fields = [k.cast("string"), F.col("o_custkey").cast("string"),
              F.date_format(F.col("o_orderdate").cast("date"), "yyyyMM"),
              F.regexp_replace(F.format_number(F.col("o_totalprice"), 2), ",", ""),
              (F.lit(5) - F.substring("o_orderpriority", 1, 1).cast("int")).cast("string")]
    full = F.concat_ws("|", *fields)
    return (F.when(k % LONG_EVERY == 0, F.concat(full, F.lit("|extra")))
             .when(k % SHORT_EVERY == 0, F.concat_ws("|", *fields[:4]))
             .otherwise(full))


def _stage_monthly_text(spark, sf_dir):
    """Orders written as several pipe-delimited text files (no header)."""
    out = D.staging_dir(spark, "monthly-text")
    T.table(spark, sf_dir, "orders").select(_monthly_line().alias("value")) \
        .repartition(4).write.mode("overwrite").text(out)
    return out


_SCAN_SQL = f"""
select o_orderkey as obs, cast(o_custkey as varchar) as loanSeqNumber,
       cast(date_trunc('month', o_orderdate) as date) as mthlyRepPeriod, round(o_totalprice, 2) as currUPB,
       case when o_orderkey % {SHORT_EVERY} = 0 then null
            else cast(5 - cast(substr(o_orderpriority, 1, 1) as int) as varchar) end as currLoanDelinqStatus
from orders where o_orderkey % {LONG_EVERY} <> 0"""


@query("delimited_scan", _SCAN_SQL)
def delimited_scan(spark, sf_dir):
    """Multi-file pipe scan, long lines skipped, short kept."""
    path = _stage_monthly_text(spark, sf_dir)
    df = D.load_delimited(spark, path + "/*.txt", SCAN_COLUMNS, bad_lines="skip",
                          col_types={"obs": "bigint", "currUPB": "double"},
                          date_formats={"mthlyRepPeriod": "yyyyMM"})
    return df.select("obs", "loanSeqNumber", "mthlyRepPeriod", rnd("currUPB", 2).alias("currUPB"),
                     "currLoanDelinqStatus")


@query("file_choice", _SCAN_SQL + " and year(o_orderdate) in (1996, 1998)")
def file_choice(spark, sf_dir):
    """A5: read only the files whose path carries one of the period tokens."""
    o = T.table(spark, sf_dir, "orders")
    path = D.staging_dir(spark, "monthly-periods")
    (o.select(_monthly_line().alias("value"),
              F.concat(F.lit("Q"), F.year("o_orderdate").cast("string")).alias("period"))
      .write.mode("overwrite").partitionBy("period").text(path))
    df = D.load_delimited(spark, path + "/period=*/*.txt", SCAN_COLUMNS, bad_lines="skip",
                          col_types={"obs": "bigint", "currUPB": "double"},
                          date_formats={"mthlyRepPeriod": "yyyyMM"},
                          period_tokens=["period=Q1996/", "period=Q1998/"])
    return df.select("obs", "loanSeqNumber", "mthlyRepPeriod", rnd("currUPB", 2).alias("currUPB"),
                     "currLoanDelinqStatus")


@query("row_limit", f"""
select o_orderkey as obs, cast(o_custkey as varchar) as loanSeqNumber from orders
where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 order by o_orderkey limit {D.SAMPLE_ROWS}""")
def row_limit(spark, sf_dir):
    """A3: the first ``nrows`` records ('sample' = 10,000) of a set of files, in which every seventh line
    is too long and every eleventh is blank."""
    o = T.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    line = F.concat_ws("|", key.cast("string"), F.col("o_custkey").cast("string"), F.when(key % 7 == 0, "extra"))
    path = D.staging_dir(spark, "monthly-sorted")
    o.select(F.when(key % 11 == 0, "").otherwise(line).alias("value"), key).orderBy(key).select("value") \
        .write.mode("overwrite").option("maxRecordsPerFile", 4_000).text(path)
    return D.load_delimited(spark, path + "/*.txt", ["obs", "loanSeqNumber"], nrows=D.SAMPLE_ROWS,
                            col_types={"obs": "bigint"})


@query("census_rename", """
select cast(c_custkey as bigint) as customerKey, c_name as customerName, cast(c_nationkey as int) as nationKey,
       round(c_acctbal, 2) as accountBalance, c_mktsegment as segment from customer""")
def census_rename(spark, sf_dir):
    """Headed CSV + Field -> Renamed dictionary + cast spec."""
    c = T.table(spark, sf_dir, "customer")
    base = D.staging_dir(spark, "census")
    c.write.mode("overwrite").option("header", True).csv(f"{base}/data/customers.csv")
    renames = {"c_custkey": "customerKey", "c_name": "customerName", "c_nationkey": "nationKey",
               "c_acctbal": "accountBalance", "c_mktsegment": "segment"}
    spark.createDataFrame(list(renames.items()), "Field string, Renamed string") \
        .coalesce(1).write.mode("overwrite").option("header", True).csv(f"{base}/dictionary")
    df = D.load_census(spark, f"{base}/data", "customers", nrows=None, dictionary_path=f"{base}/dictionary",
                       col_types={"customerKey": "bigint", "nationKey": "int", "accountBalance": "double"})
    return df.select("customerKey", "customerName", "nationKey", rnd("accountBalance", 2).alias("accountBalance"),
                     "segment")


@query("csv_sink", T.with_ctes("loans") + """
select loan, servicer, msa, score, round(balance, 2) as balance from loans""")
def csv_sink(spark, sf_dir):
    """Write a table as delimited text and read it back typed."""
    path = D.staging_dir(spark, "csv-sink")
    D.write_delimited(T.loans(spark, sf_dir), path, sep="|", header=False)
    df = D.load_delimited(spark, path + "/*.csv", ["loan", "servicer", "msa", "score", "balance"],
                          col_types={"loan": "bigint", "msa": "int", "score": "int", "balance": "double"})
    return df.select("loan", "servicer", "msa", "score", rnd("balance", 2).alias("balance"))


@query("stage_roundtrip", T.with_ctes("panel") + """
select loan, obs, d, month, upb, status from panel""")
def stage_roundtrip(spark, sf_dir):
    """Stage a table as Parquet partitioned by month and read it back."""
    path = D.staging_dir(spark, "stage")
    D.write_stage(T.panel(spark, sf_dir), path, partition_by=["month"])
    df = D.read_stage(spark, path)
    return df.select("loan", "obs", "d", F.col("month").cast("date").alias("month"), "upb", "status")


# small bins, so that the driver tables open many of them
_CAP = 100

_BIN_SQL = f"""
with l as (select distinct o_custkey as loan from orders),
i as (select loan, row_number() over (order by loan) - 1 as idx from l),
m as (select loan, cast(floor(idx / {_CAP}) as int) as binNumber from i)
select loan, binNumber, cast(count(*) over (partition by binNumber) as int) as binOccupancy,
       {_CAP} as maxBinOccupancy from m"""


@query("bins", _BIN_SQL)
def bins(spark, sf_dir):
    """Loans in fixed-capacity bins, numbered in loan order."""
    loans = T.panel(spark, sf_dir).select("loan")
    return B.create_bins(loans, "loan", _CAP)


CUTOFF = "1996-01-01"

_BIN_UPDATE_SQL = f"""
with f as (select o_custkey as loan, min(o_orderdate) as fd from orders group by o_custkey),
b as (select loan, cast(floor((row_number() over (order by loan) - 1) / {_CAP}) as int) as binNumber
      from f where fd < timestamp '{CUTOFF}'),
occ as (select binNumber, count(*) as n from b group by binNumber),
st as (select coalesce(max(binNumber), -1) as top,
              min(case when n < {_CAP} then binNumber end) as open_bin,
              coalesce(max(case when n < {_CAP} then {_CAP} - n end), 0) as spots from occ),
nw as (select loan, row_number() over (order by loan) - 1 as idx from f where loan not in (select loan from b)),
a as (select loan, cast(case when idx < st.spots then st.open_bin
                             else st.top + 1 + floor((idx - st.spots) / {_CAP}) end as int) as binNumber
      from nw, st),
m as (select * from b union all select * from a)
select loan, binNumber, cast(count(*) over (partition by binNumber) as int) as binOccupancy,
       {_CAP} as maxBinOccupancy from m"""


@query("bin_update", _BIN_UPDATE_SQL)
def bin_update(spark, sf_dir):
    """Bins of the loans seen before the cutoff, then the later loans
    added batch-wise (open bin first, then new bins)."""
    p = T.panel(spark, sf_dir)
    first = p.groupBy("loan").agg(F.min("d").alias("fd"))
    base = B.create_bins(first.where(F.col("fd") < F.lit(CUTOFF).cast("date")), "loan", _CAP)
    return B.update_bins(base, p.select("loan"), "loan", _CAP)


@query("bin_stream", f"""
with f as (select o_custkey as loan, min(year(o_orderdate)) as yr from orders group by o_custkey),
m as (select loan, cast(floor((row_number() over (order by yr, loan) - 1) / {_CAP}) as int) as binNumber from f)
select loan as loanSeqNumber, binNumber, cast(count(*) over (partition by binNumber) as int) as binOccupancy,
       {_CAP} as maxBinOccupancy from m""")
def bin_stream(spark, sf_dir):
    """A15 as a stream: the years arrive one after another, each micro-batch adds its new loans to the bin
    map; returns the final map."""
    from loanpanel.streaming.bin_stream import latest_map
    return latest_map(spark, f"{_run_bin_stream(spark, sf_dir)}/map")


@query("bin_stream_rows", f"""
with f as (select o_custkey as loan, min(year(o_orderdate)) as yr from orders group by o_custkey),
m as (select loan, cast(floor((row_number() over (order by yr, loan) - 1) / {_CAP}) as int) as binNumber from f)
select o_custkey as loanSeqNumber, o_orderkey as obs, cast(year(o_orderdate) as int) as yr, m.binNumber
from orders join m on m.loan = o_custkey""")
def bin_stream_rows(spark, sf_dir):
    """The rows that the stream routed to the bins, old loans' rows of later batches among them."""
    base = _run_bin_stream(spark, sf_dir)
    return spark.read.parquet(f"{base}/data").select("loanSeqNumber", "obs", "yr", "binNumber")


def _run_bin_stream(spark, sf_dir) -> str:
    """Run the stream over the years of the orders, one after another; its folder."""
    from loanpanel.streaming.bin_stream import start_bin_stream
    base = D.staging_dir(spark, "bin-stream")
    o = T.table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").cast("long").alias("loanSeqNumber"), F.col("o_orderkey").cast("long").alias("obs"),
                    F.year("o_orderdate").alias("yr"))
    for r in rows.select("yr").distinct().orderBy("yr").collect():          # calendar years: a handful
        rows.where(F.col("yr") == r["yr"]).write.mode("append").parquet(f"{base}/incoming")
        src = spark.readStream.schema("loanSeqNumber long, obs long, yr int").parquet(f"{base}/incoming")
        q = start_bin_stream(spark, src, f"{base}/map", f"{base}/data", f"{base}/checkpoint", capacity=_CAP)
        q.awaitTermination()
    return base


@query("loans_per_file", """
select concat('Q', cast(year(o_orderdate) as varchar)) as period, count(distinct cast(o_custkey as varchar)) as n_loans,
       count(*) as n_rows from orders where o_orderkey % 97 <> 0 group by 1""")
def loans_per_file(spark, sf_dir):
    """F9 + A4/A5: distinct loans and rows per period file of a multi-file scan."""
    o = T.table(spark, sf_dir, "orders")
    path = D.staging_dir(spark, "monthly-files")
    (o.select(_monthly_line().alias("value"),
              F.concat(F.lit("Q"), F.year("o_orderdate").cast("string")).alias("period"))
      .write.mode("overwrite").partitionBy("period").text(path))
    df = D.load_delimited(spark, path + "/period=*/*.txt", SCAN_COLUMNS, keep_file_name=True)
    df = df.withColumn("period", F.regexp_extract("__file", r"period=(Q[0-9]+)/", 1))
    return df.groupBy("period").agg(F.count_distinct("loanSeqNumber").alias("n_loans"),
                                    F.count(F.lit(1)).alias("n_rows"))


def _fields_line(fields):
    """Pipe-join fields, writing NULL as an empty field (concat_ws would skip it)."""
    return F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


@query("origination_load", T.with_ctes("dirty_loans") + f""",
c as (select * from dirty_loans
      where score_raw is not null and not contains(score_raw, ' ') and try_cast(score_raw as int) is not null
        and length(cast(try_cast(score_raw as int) as varchar)) in (2, 3)
        and length(trim(first_raw)) in (5, 6))
select cast(loan as varchar) as loanSeqNumber, try_cast(score_raw as int) as creditScore,
       cast(try_strptime(first_raw, '%Y%m') as date) as firstPaymentDate,
       cast(try_strptime(cast(cast(substr(first_raw, 1, 4) as int) + 30 as varchar) || '01', '%Y%m') as date)
         as maturityDate,
       cast(msa as varchar) as MSA, round(balance, 2) as origUPB, 360 as origLoanTerm, 2 as borrowers,
       servicer as servicerName
from c""")
def origination_load(spark, sf_dir):
    """A6 (+ A1, A10, A11, B1-B4): customers written as 26-column origination
    files and loaded back through the origination loader."""
    from loanpanel import schema as S
    d = T.dirty_loans(spark, sf_dir)
    values = {
        "creditScore": F.col("score_raw"), "firstPaymentDate": F.col("first_raw"),
        "firstTimeBuyFlag": F.col("flag_raw"),
        "maturityDate": F.concat((F.substring("first_raw", 1, 4).cast("int") + 30).cast("string"), F.lit("01")),
        "MSA": F.col("msa"), "mtgInsurancePct": F.lit("000"), "numberUnits": F.lit("1"),
        "occStatus": F.lit("O"), "origCLTV": F.lit(""), "origDTI": F.lit("   "),
        "origUPB": F.format_string("%.2f", F.col("balance")), "origLTV": F.lit("80"),
        "origInterestRate": F.lit("6.5"), "channel": F.col("channel_raw"),
        "prepayPenaltyMtgFlag": F.lit("N"), "productType": F.lit("FRM"), "propertyState": F.lit("XX"),
        "propertyType": F.lit("SF"), "postalCode": F.col("postal_raw"), "loanSeqNumber": F.col("loan"),
        "loanPurpose": F.lit("P"), "origLoanTerm": F.lit("360"), "borrowers": F.lit("2"),
        "sellerName": F.col("servicer"), "servicerName": F.col("servicer"), "superConformingFlag": F.lit(""),
    }
    path = D.staging_dir(spark, "origination-files")
    d.select(_fields_line([values[c] for c in S.ORIGINATION_COLUMNS]).alias("value")) \
        .repartition(3).write.mode("overwrite").text(path)
    o = D.load_origination(spark, path)
    return o.select("loanSeqNumber", "creditScore", "firstPaymentDate", "maturityDate", "MSA",
                    rnd("origUPB", 2).alias("origUPB"), "origLoanTerm", "borrowers", "servicerName")


@query("monthly_load_typed", """
select cast(o_custkey as varchar) as loanSeqNumber, cast(date_trunc('month', o_orderdate) as date) as mthlyRepPeriod,
       round(cast(round(o_totalprice, 2) as double), 2) as currUPB, cast(o_orderkey % 360 as double) as loanAge,
       case when o_orderkey % 5 = 0 then null else cast(360 - o_orderkey % 360 as double) end as remainingMonthsLegMaturity,
       cast(o_orderkey % 8 + 0.125 as double) as currInterestRate, cast(null as double) as currDeferredUPB
from orders""")
def monthly_load_typed(spark, sf_dir):
    """The monthly loader's typed columns, one of them with unreadable numbers."""
    from loanpanel import schema as S
    o = T.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    values = {c: F.lit(None).cast("string") for c in S.MONTHLY_COLUMNS}
    values.update({
        "loanSeqNumber": F.col("o_custkey"), "mthlyRepPeriod": F.date_format("o_orderdate", "yyyyMM"),
        "currUPB": F.format_string("%.2f", F.col("o_totalprice")), "loanAge": k % 360,
        "remainingMonthsLegMaturity": F.when(k % 5 == 0, "XX").otherwise((360 - k % 360).cast("string")),
        "currInterestRate": F.concat((k % 8).cast("string"), F.lit(".125")),
    })
    path = D.staging_dir(spark, "monthly-typed")
    o.select(_fields_line([values[c] for c in S.MONTHLY_COLUMNS]).alias("value")).write.mode("overwrite").text(path)
    return D.load_monthly(spark, path).select("loanSeqNumber", "mthlyRepPeriod", rnd("currUPB", 2).alias("currUPB"), *[c for c in S.MONTHLY_TYPES if c != "currUPB"])


@query("monthly_load", T.with_ctes("dirty_months") + """,
z as (select cast(loan as varchar) as loanSeqNumber, d, cast(date_trunc('month', d) as date) as mthlyRepPeriod,
             round(upb_raw, 2) as currUPB, status_raw, zero_code_raw from dirty_months)
select loanSeqNumber, mthlyRepPeriod,
       round(coalesce(currUPB, (select median(currUPB) from z)), 4) as currUPB,
       coalesce(try_cast(replace(trim(status_raw), 'R', '7') as double), 0.0) as currLoanDelinqStatus,
       coalesce(case (case when length(replace(zero_code_raw, '.0', '')) < 2
                           then lpad(replace(zero_code_raw, '.0', ''), 2, '0')
                           else replace(zero_code_raw, '.0', '') end)
             when '00' then 'unknown' when '01' then 'prepaid_matured' when '03' then 'foreclosure_alternative'
             when '06' then 'repurchase' when '09' then 'REO_disposition' end, '00') as zeroBalanceCode,
       cast(0.0 as double) as expenses, 0 as repurchaseFlag
from z""")
def monthly_load(spark, sf_dir):
    """A7 + L12: orders written as 24-column monthly performance files, loaded
    back through the monthly loader and prepared by the monthly pipeline."""
    from loanpanel import schema as S
    from loanpanel.operators.prep import prep_monthly
    d = T.dirty_months(spark, sf_dir)
    blank = F.lit(None).cast("string")
    values = {c: blank for c in S.MONTHLY_COLUMNS}
    values.update({
        "loanSeqNumber": F.col("loan"), "mthlyRepPeriod": F.date_format("d", "yyyyMM"),
        "currUPB": F.format_string("%.2f", F.col("upb_raw")), "currLoanDelinqStatus": F.col("status_raw"),
        "repurchaseFlag": F.lit("N"), "zeroBalanceCode": F.col("zero_code_raw"),
    })
    path = D.staging_dir(spark, "monthly-files")
    d.select(_fields_line([values[c] for c in S.MONTHLY_COLUMNS]).alias("value")) \
        .repartition(max(3, spark.sparkContext.defaultParallelism)).write.mode("overwrite").text(path)
    m = D.load_monthly(spark, path).select("loanSeqNumber", "mthlyRepPeriod", "currUPB", "currLoanDelinqStatus",
                                           "zeroBalanceCode", "expenses", "repurchaseFlag")
    # staged: the prep reads its rows for the medians, the codes and the result, the text is split once
    p = prep_monthly(D.read_stage(spark, D.write_stage(m, D.staging_dir(spark, "monthly-loaded"))))
    return p.select("loanSeqNumber", "mthlyRepPeriod", rnd("currUPB", 4).alias("currUPB"),
                    "currLoanDelinqStatus", "zeroBalanceCode", "expenses", "repurchaseFlag")
