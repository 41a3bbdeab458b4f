"""Cleaning, encoding, profiling and join queries (B, C, D, E groups; L12, L13)
on the dirty bindings of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanpanel.functions.exprs import rnd
from loanpanel.operators import clean as CL
from loanpanel.operators import encode as EN
from loanpanel.operators import joins as J
from loanpanel.operators import quality as Q
from loanpanel.plans import driver_tables as T
from loanpanel.plans.registry import query
from loanpanel.session import cut_lineage

# ---------------------------------------------------------------- B group


@query("clean_scores", T.with_ctes("dirty_loans") + """
select loan, try_cast(score_raw as int) as creditScore from dirty_loans
where score_raw is not null and not contains(score_raw, ' ') and try_cast(score_raw as int) is not null
  and length(cast(try_cast(score_raw as int) as varchar)) in (2, 3)""")
def clean_scores(spark, sf_dir):
    d = T.dirty_loans(spark, sf_dir).select("loan", F.col("score_raw").alias("creditScore"))
    return CL.clean_scores(d)


def _parse_sql(c: str) -> str:
    """SQL twin of ``parse_yyyymm``: strip a trailing '.0', pad a 5-character code, parse yyyyMM."""
    s = f"trim(regexp_replace({c}, '\\.0$', ''))"
    return (f"cast(case when length({s}) = 5 then try_strptime(concat(substr({s}, 1, 4), "
            f"lpad(substr({s}, 5, 1), 2, '0')), '%Y%m') "
            f"when length({s}) = 6 then try_strptime({s}, '%Y%m') end as date)")


@query("date_shape", T.with_ctes("dirty_loans") + f"""
select loan, first_raw, {_parse_sql('first_raw')} as firstPaymentDate
from dirty_loans where length(trim(first_raw)) in (5, 6)""")
def date_shape(spark, sf_dir):
    d = T.dirty_loans(spark, sf_dir).select("loan", "first_raw")
    return CL.keep_date_shape(d, "first_raw", "firstPaymentDate")


# ---------------------------------------------------------------- D group


@query("median_impute", T.with_ctes("dirty_months") + """
select loan, obs, round(coalesce(upb_raw, (select median(upb_raw) from dirty_months)), 4) as currUPB
from dirty_months""")
def median_impute(spark, sf_dir):
    d = T.dirty_months(spark, sf_dir).select("loan", "obs", F.col("upb_raw").alias("currUPB"))
    return CL.median_impute(d, ["currUPB"]).select("loan", "obs", rnd("currUPB", 4).alias("currUPB"))


@query("constant_fill", T.with_ctes("dirty_months") + """
select obs, coalesce(upb_raw, 0.0) as upb, coalesce(zero_code_raw, '00') as zero_code,
       coalesce(status_raw, '0') as status from dirty_months""")
def constant_fill(spark, sf_dir):
    d = T.dirty_months(spark, sf_dir).select(
        "obs", F.col("upb_raw").alias("upb"), F.col("zero_code_raw").alias("zero_code"),
        F.col("status_raw").alias("status"))
    return CL.constant_fill(d, {"upb": 0.0, "zero_code": "00", "status": "0"})


_STATUS_SQL = "coalesce(try_cast(replace(trim(status_raw), 'R', '7') as double), 0.0)"


@query("status_number", T.with_ctes("dirty_months") + f"""
select obs, {_STATUS_SQL} as status,
       case when {_STATUS_SQL} >= 2 then 1 else 0 end as serious_delinquency,
       case least(cast({_STATUS_SQL} as int), 7) when 0 then '0_29days_delinquent'
            when 1 then '30_59days delinquent' when 2 then '60_89days delinquent'
            when 3 then '90_119days delinquent' when 4 then '120_149days delinquent'
            when 5 then '150_179days_delinquent' when 6 then '180_209days_delinquent'
            else '210_plus' end as delinquency_bucket
from dirty_months""")
def status_number(spark, sf_dir):
    d = EN.status_to_number(T.dirty_months(spark, sf_dir), "status_raw", "status")
    return d.select("obs", "status", EN.serious_delinquency("status").alias("serious_delinquency"),
                    EN.delinquency_bucket("status").alias("delinquency_bucket"))


@query("flag_map", T.with_ctes("dirty_loans") + """
select loan, case when flag_raw = 'Y' then 1 else 0 end as flag from dirty_loans""")
def flag_map(spark, sf_dir):
    d = T.dirty_loans(spark, sf_dir).select("loan", F.col("flag_raw").alias("flag"))
    return EN.flag_map(d, ["flag"])


_DECODE_SQL = """coalesce(case (case when length(replace(zero_code_raw, '.0', '')) < 2
                           then lpad(replace(zero_code_raw, '.0', ''), 2, '0')
                           else replace(zero_code_raw, '.0', '') end)
             when '00' then 'unknown' when '01' then 'prepaid_matured' when '03' then 'foreclosure_alternative'
             when '06' then 'repurchase' when '09' then 'REO_disposition' end, '00')"""


@query("code_decode", T.with_ctes("dirty_months") + f"""
select obs, {_DECODE_SQL} as zeroBalanceCode from dirty_months""")
def code_decode(spark, sf_dir):
    d = T.dirty_months(spark, sf_dir)
    return d.select("obs", EN.decode_zero_balance("zero_code_raw").alias("zeroBalanceCode"))


_ZB_VALUES = ("00", "REO_disposition", "prepaid_matured")  # observed in the bound tables at every scale


@query("one_hot_dynamic", T.with_ctes("dirty_months") + f""",
z as (select obs, {_DECODE_SQL} as zeroBalanceCode from dirty_months)
select obs, zeroBalanceCode, """ + ", ".join(
    f"case when zeroBalanceCode = '{v}' then 1 else 0 end as zeroBalCode_{v}" for v in _ZB_VALUES) + """
from z""")
def one_hot_dynamic(spark, sf_dir):
    z = T.dirty_months(spark, sf_dir).select(
        "obs", EN.decode_zero_balance("zero_code_raw").alias("zeroBalanceCode"))
    return EN.one_hot_dynamic(z, "zeroBalanceCode", prefix="zeroBalCode")


@query("one_hot_static", T.with_ctes("dirty_loans") + """
select loan, """ + ", ".join(f"case when trim(channel_raw) = '{c}' then 1 else 0 end as {n}"
                             for c, n in EN.CHANNEL_NAMES.items()) + """
from dirty_loans""")
def one_hot_static(spark, sf_dir):
    d = T.dirty_loans(spark, sf_dir).select("loan", F.col("channel_raw").alias("channel"))
    return EN.one_hot_static(d, "channel", EN.CHANNEL_NAMES, trim=True, named=True, drop_source=True)


@query("label_encode", T.with_ctes("dirty_loans") + """,
v as (select distinct coalesce(flag_raw, 'N') as f from dirty_loans),
r as (select f, cast(row_number() over (order by f) - 1 as int) as idx from v)
select loan, r.idx as firstTimeBuyFlag from dirty_loans join r on coalesce(flag_raw, 'N') = r.f""")
def label_encode(spark, sf_dir):
    d = T.dirty_loans(spark, sf_dir).select("loan", F.col("flag_raw").alias("firstTimeBuyFlag"))
    return EN.label_encode(d, "firstTimeBuyFlag", fill="N")


@query("label_encode_wide", """
with v as (select distinct o_orderkey % 7 || '-' || o_custkey || '-' || o_orderpriority as f from orders),
r as (select f, cast(row_number() over (order by f) - 1 as int) as idx from v)
select o_orderkey as obs, r.idx as code from orders join r on o_orderkey % 7 || '-' || o_custkey || '-' || o_orderpriority = r.f""")
def label_encode_wide(spark, sf_dir):
    """D9 on a column of very many values (over 10,000 from sf0.01 on)."""
    o = T.table(spark, sf_dir, "orders")
    text = F.concat_ws("-", F.col("o_orderkey") % 7, "o_custkey", "o_orderpriority")
    return EN.label_encode(o.select(F.col("o_orderkey").alias("obs"), text.alias("code")), "code")


@query("pad_strip", T.with_ctes("dirty_loans") + """
select loan, case when length(replace(postal_raw, '.0', '')) < 5 then lpad(replace(postal_raw, '.0', ''), 5, '0')
                  else replace(postal_raw, '.0', '') end as postalCode
from dirty_loans""")
def pad_strip(spark, sf_dir):
    d = T.dirty_loans(spark, sf_dir).select("loan", F.col("postal_raw").alias("postalCode"))
    return EN.strip_and_pad(d, "postalCode", 5)


@query("blank_to_zero", T.with_ctes("dirty_loans") + """
select loan, try_cast(replace(replace(replace(score_raw, '   ', '0'), '000', '0'), ' ', '0') as double) as value
from dirty_loans""")
def blank_to_zero(spark, sf_dir):
    d = T.dirty_loans(spark, sf_dir)
    return d.select("loan", EN.blank_to_zero("score_raw").alias("value"))


_PREPAY_YES = ("Y", "78", "78.0")
_CHANNEL_SENTINELS = {"B": "B", "H": "H"}


@query("coded_flag", T.with_ctes("dirty_loans") + """
select loan, case when flag_raw in ('Y', '78', '78.0') then 1 else 0 end as prepayPenaltyMtgFlag,
       case when channel_raw = 'B' then 1 else 0 end as channel_raw_B,
       case when channel_raw = 'H' then 1 else 0 end as channel_raw_H
from dirty_loans""")
def coded_flag(spark, sf_dir):
    d = T.dirty_loans(spark, sf_dir).select("loan", "channel_raw", F.col("flag_raw").alias("prepayPenaltyMtgFlag"))
    d = EN.flag_map(d, ["prepayPenaltyMtgFlag"], yes_values=_PREPAY_YES)
    return EN.sentinel_indicators(d, "channel_raw", _CHANNEL_SENTINELS).drop("channel_raw")


@query("month_parts", T.with_ctes("dirty_loans") + f""",
p as (select loan, first_raw, {_parse_sql('first_raw')} as first_raw_date from dirty_loans)
select loan, first_raw, first_raw_date, strftime(first_raw_date, '%Y-%m') as first_raw_month,
       cast(year(first_raw_date) as int) as first_raw_year from p""")
def month_parts(spark, sf_dir):
    d = T.dirty_loans(spark, sf_dir).select("loan", "first_raw")
    return EN.month_parts(d, "first_raw")


@query("abs_deviation", T.with_ctes("panel") + """
select obs, round(abs(upb - (select avg(upb) from panel)), 4) as upb_stzd from panel""")
def abs_deviation(spark, sf_dir):
    p = T.panel(spark, sf_dir).select("obs", "upb")
    return EN.abs_deviation(p, ["upb"]).select("obs", rnd("upb_stzd", 4).alias("upb_stzd"))


@query("sentinel_median", T.with_ctes("dirty_loans") + """,
v as (select loan, case when score_raw in ('   ', '000') then null else try_cast(score_raw as double) end as x
      from dirty_loans)
select loan, round(coalesce(x, (select median(x) from v)), 4) as score from v""")
def sentinel_median(spark, sf_dir):
    d = T.dirty_loans(spark, sf_dir).select("loan", F.col("score_raw").alias("score"))
    return CL.sentinel_to_median(d, ["score"]).select("loan", rnd("score", 4).alias("score"))


# ---------------------------------------------------------------- C group

_DM_COLS = ("loan", "obs", "d", "status_raw", "zero_code_raw", "upb_raw")


@query("null_report", T.with_ctes("dirty_months") + "\n" + "\nunion all\n".join(
    f"select '{c}' as column_name, cast(count(*) - count({c}) as bigint) as n_null, count(*) as n_rows "
    f"from dirty_months" for c in _DM_COLS))
def null_report(spark, sf_dir):
    return Q.null_counts(T.dirty_months(spark, sf_dir).select(*_DM_COLS))


def _profiled(spark, sf_dir):
    return T.dirty_loans(spark, sf_dir).select(
        "loan", "score_raw", "channel_raw", "flag_raw",
        F.lit("customer").alias("source"), F.lit(None).cast("string").alias("empty"))


_PROFILE_COLS = ("loan", "score_raw", "channel_raw", "flag_raw", "source", "empty")
_PROFILED_SQL = T.with_ctes("dirty_loans") + """,
pf as (select loan, score_raw, channel_raw, flag_raw, 'customer' as source, cast(null as varchar) as empty
       from dirty_loans)"""


@query("constant_columns", _PROFILED_SQL + "\n" + "\nunion all\n".join(
    f"select '{c}' as column_name, count(*) as n_rows, count({c}) as n_nonnull, count({c}) = 0 as all_null, "
    f"(count({c}) = count(*) and count(*) > 0 and coalesce(cast(min({c}) as varchar) = cast(max({c}) as varchar), "
    f"false)) as is_constant from pf" for c in _PROFILE_COLS))
def constant_columns(spark, sf_dir):
    return Q.column_profile(_profiled(spark, sf_dir))


@query("value_counts", _PROFILED_SQL + "\n" + "\nunion all\n".join(
    f"select '{c}' as column_name, cast({c} as varchar) as value, count(*) as count from pf group by 2"
    for c in ("channel_raw", "flag_raw", "source")))
def value_counts(spark, sf_dir):
    return Q.value_counts(_profiled(spark, sf_dir), ["channel_raw", "flag_raw", "source"])


_HOMO_COLS = ("score_raw", "channel_raw", "flag_raw", "source", "empty")


@query("homogeneity", _PROFILED_SQL + ",\nvc as (" + "\nunion all\n".join(
    f"select '{c}' as column_name, cast({c} as varchar) as value, count(*) as n from pf "
    f"where {c} is not null group by 2" for c in _HOMO_COLS) + """)
select column_name, max(n) as top_n, cast(sum(n) as bigint) as n_nonnull, round(max(n) / sum(n), 6) as top_share,
       max(n) / sum(n) > 0.99 as homogeneous
from vc group by column_name""")
def homogeneity(spark, sf_dir):
    h = Q.homogeneity(_profiled(spark, sf_dir), list(_HOMO_COLS))
    return h.select("column_name", "top_n", F.col("n_nonnull").cast("long").alias("n_nonnull"),
                    rnd("top_share", 6).alias("top_share"), "homogeneous")


_MAJORITY_COLS = (*_HOMO_COLS, "half", "most", "void")
_MAJORITY_SQL = ["case when loan % 2 = 0 then 'even' else cast(loan as varchar(20)) end as half",
                 "case when loan % 200 = 0 then loan when loan % 97 = 0 then null else 7 end as most",
                 "cast(null as int) as void"]


@query("homogeneity_majority", _PROFILED_SQL + f""",
mj as (select *, {", ".join(_MAJORITY_SQL)} from pf),
vc as (""" + "\nunion all\n".join(
    f"select '{c}' as column_name, cast({c} as varchar) as value, count({c}) as n from mj group by 2" for c in _MAJORITY_COLS) + """),
per as (select column_name, max(n) as n, cast(sum(n) as bigint) as n_nonnull from vc group by column_name)
select column_name, n_nonnull, case when 2 * n > n_nonnull then n end as majority_n,
       2 * n > n_nonnull and n / n_nonnull > 0.99 as homogeneous
from per""")
def homogeneity_majority(spark, sf_dir):
    """C9 without counting every value: majority candidates from sketches, then one exact pass."""
    mj = _profiled(spark, sf_dir).selectExpr("*", *_MAJORITY_SQL)
    return Q.majority_values(mj, _MAJORITY_COLS, 0.99)


_VAR_COLS = ("loan", "msa", "score", "balance")


@query("variance_filter", T.with_ctes("loans") + "\n" + "\nunion all\n".join(
    f"select '{c}' as column_name, round(var_pop({c}), 4) as variance, coalesce(var_pop({c}) > 0.0, false) as kept "
    f"from loans" for c in _VAR_COLS))
def variance_filter(spark, sf_dir):
    v = Q.variance_profile(T.loans(spark, sf_dir).select(*_VAR_COLS))
    return v.select("column_name", rnd("variance", 4).alias("variance"), "kept")


def _bin_sql(x: str, lo: str, hi: str) -> str:
    return (f"cast(least(floor(({x} - case when {hi} = {lo} then {lo} - 0.5 else {lo} end) / "
            f"case when {hi} = {lo} then 0.1 else ({hi} - {lo}) / 10.0 end), 9) as int)")


@query("histogram", T.with_ctes("panel") + """,
rng as (select min(cast(upb as double)) as lu, max(cast(upb as double)) as hu,
               min(cast(status as double)) as ls, max(cast(status as double)) as hs from panel)
select column_name, bin, count(*) as count from (
  select 'upb' as column_name, """ + _bin_sql("cast(upb as double)", "lu", "hu") + """ as bin from panel, rng
  union all
  select 'status' as column_name, """ + _bin_sql("cast(status as double)", "ls", "hs") + """ as bin from panel, rng)
where bin is not null group by column_name, bin""")
def histogram(spark, sf_dir):
    return Q.histogram(T.panel(spark, sf_dir), ["upb", "status"])


@query("histogram_by_group", T.with_ctes("loans") + """,
b as (select servicer, cast(score as double) as x from loans where servicer is not null and score is not null),
rng as (select servicer, min(x) as lo, max(x) as hi from b group by servicer)
select servicer, """ + _bin_sql("x", "lo", "hi") + """ as bin, count(*) as count
from b join rng using (servicer) group by 1, 2""")
def histogram_by_group(spark, sf_dir):
    return Q.histogram_by_group(T.loans(spark, sf_dir), "servicer", "score")


# ---------------------------------------------------------------- E group


@query("combine", T.with_ctes("panel", "loans") + """
select loan, obs, d, servicer, msa, score, upb, status from loans join panel using (loan) where d is not null""")
def combine(spark, sf_dir):
    c = J.combine(T.loans(spark, sf_dir), T.panel(spark, sf_dir), "loan", not_null=["d"])
    return c.select("loan", "obs", "d", "servicer", "msa", "score", "upb", "status")


@query("semi_both", T.with_ctes("panel", "loans") + """
select 'loans' as side, count(*) as n from loans where loan in (select loan from panel)
union all
select 'months' as side, count(*) as n from panel where loan in (select loan from loans)""")
def semi_both(spark, sf_dir):
    a, b = J.semi_both(T.loans(spark, sf_dir), T.panel(spark, sf_dir), "loan")
    return a.agg(F.count(F.lit(1)).alias("n")).select(F.lit("loans").alias("side"), "n").unionByName(
        b.agg(F.count(F.lit(1)).alias("n")).select(F.lit("months").alias("side"), "n"))


@query("anti_new", T.with_ctes("panel", "loans") + """
select loan, servicer, msa, score from loans where loan not in (select loan from panel where cast(d as date) < date '1996-01-01')""")
def anti_new(spark, sf_dir):
    """The loans without a record in the panel's first year."""
    known = T.panel(spark, sf_dir).where(F.col("d").cast("date") < F.lit("1996-01-01").cast("date"))
    return J.only_new(T.loans(spark, sf_dir), known, "loan") \
        .select("loan", "servicer", "msa", "score")


@query("lookup", T.with_ctes("panel", "loans") + """,
last as (select loan, max_by(status, obs) as last_status from panel group by loan)
select l.loan, last.last_status from loans l left join last using (loan)""")
def lookup(spark, sf_dir):
    m = T.panel(spark, sf_dir).select("loan", "status", "obs")
    out = J.lookup(T.loans(spark, sf_dir).select("loan"), m, "loan", "status", "obs", "last_status")
    return out.select("loan", "last_status")


# ---------------------------------------------------------------- L12 / L13 pipelines


@query("monthly_prep", T.with_ctes("dirty_months") + f""",
z as (select loan, obs, d as mthlyRepPeriod,
             round(coalesce(upb_raw, (select median(upb_raw) from dirty_months)), 4) as currUPB,
             {_STATUS_SQL} as currLoanDelinqStatus, {_DECODE_SQL} as zeroBalanceCode
      from dirty_months where d is not null)
select *, """ + ", ".join(f"case when zeroBalanceCode = '{v}' then 1 else 0 end as zeroBalCode_{v}"
                          for v in _ZB_VALUES) + " from z")
def monthly_prep(spark, sf_dir):
    from loanpanel.operators.prep import prep_monthly
    d = T.dirty_months(spark, sf_dir).select(
        F.col("loan").alias("loanSeqNumber"), "obs", F.col("d").alias("mthlyRepPeriod"),
        F.col("upb_raw").alias("currUPB"), F.col("status_raw").alias("currLoanDelinqStatus"),
        F.col("zero_code_raw").alias("zeroBalanceCode"))
    out = prep_monthly(d, zero_balance_values=_ZB_VALUES)
    return out.withColumnRenamed("loanSeqNumber", "loan").withColumn("currUPB", rnd("currUPB", 4))


_PREPPED = ["loanSeqNumber", "mthlyRepPeriod", "currUPB", "currLoanDelinqStatus", "zeroBalanceCode",
            *[f"zeroBalCode_{v}" for v in _ZB_VALUES]]


@query("monthly_prep_nulls", T.with_ctes("dirty_months") + f""",
z as (select loan as loanSeqNumber, d as mthlyRepPeriod,
             coalesce(upb_raw, (select median(upb_raw) from dirty_months)) as currUPB,
             {_STATUS_SQL} as currLoanDelinqStatus, {_DECODE_SQL} as zeroBalanceCode
      from dirty_months where d is not null),
p as (select *, """ + ", ".join(f"case when zeroBalanceCode = '{v}' then 1 else 0 end as zeroBalCode_{v}" for v in _ZB_VALUES) + """ from z)
""" + "\nunion all\n".join(f"select '{c}' as column_name, count(*) - count({c}) as n_null, count(*) as n_rows from p" for c in _PREPPED))
def monthly_prep_nulls(spark, sf_dir):
    """L12's final NULL report (C4) over the projected result (B6), counted by the job that writes it."""
    from loanpanel.operators.guards import RowChecks
    from loanpanel.operators.prep import prep_monthly
    d = T.dirty_months(spark, sf_dir).select(
        F.col("loan").alias("loanSeqNumber"), "obs", F.col("d").alias("mthlyRepPeriod"),
        F.col("upb_raw").alias("currUPB"), F.col("status_raw").alias("currLoanDelinqStatus"),
        F.col("zero_code_raw").alias("zeroBalanceCode"))
    checks = RowChecks()
    cut_lineage(prep_monthly(d, zero_balance_values=_ZB_VALUES, keep=_PREPPED, checks=checks))
    n = checks.rows("prepared")
    return spark.createDataFrame([(c, k, n) for c, k in checks.null_counts("prepared").items()], "column_name string, n_null long, n_rows long")


_CHANNEL_VALUES = ("A", "B", "F", "H", "M")  # observed first letters of the bound segments


@query("origination_prep", T.with_ctes("dirty_loans") + f""",
c as (select * from dirty_loans
      where score_raw is not null and not contains(score_raw, ' ') and try_cast(score_raw as int) is not null
        and length(cast(try_cast(score_raw as int) as varchar)) in (2, 3)),
v as (select distinct coalesce(flag_raw, 'N') as f from c),
r as (select f, cast(row_number() over (order by f) - 1 as int) as idx from v)
select loan, try_cast(score_raw as int) as creditScore, {_parse_sql('first_raw')} as firstPaymentDate,
       r.idx as firstTimeBuyFlag, cast(msa as varchar) as MSA,
       case when length(replace(postal_raw, '.0', '')) < 5 then lpad(replace(postal_raw, '.0', ''), 5, '0')
            else replace(postal_raw, '.0', '') end as postalCode,
       case when flag_raw in ('Y', '78', '78.0') then 1 else 0 end as prepayPenaltyMtgFlag,
       """ + ", ".join(f"case when trim(channel_raw) = '{v}' then 1 else 0 end as channel_{v}"
                       for v in _CHANNEL_VALUES) + """
from c join r on coalesce(c.flag_raw, 'N') = r.f""")
def origination_prep(spark, sf_dir):
    from loanpanel.operators.prep import prep_origination
    d = T.dirty_loans(spark, sf_dir).select(
        F.col("loan").alias("loanSeqNumber"), F.col("score_raw").alias("creditScore"),
        F.col("first_raw").alias("firstPaymentDate"), F.col("flag_raw").alias("firstTimeBuyFlag"),
        F.col("msa").alias("MSA"), F.col("postal_raw").alias("postalCode"),
        F.col("flag_raw").alias("prepayPenaltyMtgFlag"), F.col("channel_raw").alias("channel"))
    out = prep_origination(d, channel_values=_CHANNEL_VALUES, prepay_yes=_PREPAY_YES)
    return out.withColumnRenamed("loanSeqNumber", "loan")


# ---------------------------------------------------------------- L14 / L15 older preps


@query("recent_month_prep", T.with_ctes("dirty_months") + """,
z as (select *, try_cast(replace(zero_code_raw, '.0', '') as int) as zb from dirty_months)
select loan as loanSeqNumber, d as mthlyRepPeriod_mostRecentMth, status_raw as currLoanDelinqStatus_mostRecentMth,
       """ + ", ".join(f"case when zb = {k} then 1 else 0 end as {n}_mostRecentMth"
                       for k, n in EN.ZERO_BALANCE_NAMES.items()) + """,
       case when try_cast(status_raw as double) >= 2 or trim(status_raw) = 'R' then 1 else 0 end
         as delinquencyFlag_mostRecentMth,
       round(abs(upb_raw - (select avg(upb_raw) from dirty_months)), 4) as currUPB_stzd_mostRecentMth
from z""")
def recent_month_prep(spark, sf_dir):
    from loanpanel.operators.prep import prep_most_recent_month
    d = T.dirty_months(spark, sf_dir).select(
        F.col("loan").alias("loanSeqNumber"), F.col("d").alias("mthlyRepPeriod"),
        F.col("status_raw").alias("currLoanDelinqStatus"), F.col("zero_code_raw").alias("zeroBalanceCode"),
        F.col("upb_raw").alias("currUPB"), F.lit(None).cast("string").alias("dueDateLastPaidInstallment"))
    out = prep_most_recent_month(d)
    return out.withColumn("currUPB_stzd_mostRecentMth", rnd("currUPB_stzd_mostRecentMth", 4))


@query("origination_prep_older", T.with_ctes("dirty_loans") + """
select loan as loanSeqNumber, case when flag_raw = 'Y' then 1 else 0 end as firstTimeBuyFlag_origination,
       msa as MSA_origination, round(balance, 2) as origUPB_origination, """ + ", ".join(
    f"case when trim(channel_raw) = '{c}' then 1 else 0 end as {n}_origination"
    for c, n in EN.CHANNEL_NAMES.items()) + """
from dirty_loans""")
def origination_prep_older(spark, sf_dir):
    from loanpanel.operators.prep import prep_origination_older
    d = T.dirty_loans(spark, sf_dir).select(
        F.col("loan").alias("loanSeqNumber"), F.col("flag_raw").alias("firstTimeBuyFlag"),
        F.col("msa").alias("MSA"), F.col("balance").alias("origUPB"), F.col("channel_raw").alias("channel"),
        F.lit("freddie").alias("source"), F.lit(None).cast("string").alias("Unnamed: 0"))
    out = prep_origination_older(d)
    return out.withColumn("origUPB_origination", rnd("origUPB_origination", 2))


# ---------------------------------------------------------------- B7 / B13 / C7, B16 / B17


@query("loan_level_table", T.with_ctes("loan_months") + """
select distinct loan, score as creditScore, round(balance, 2) as origUPB, msa as origNation from loan_months""")
def loan_level_table(spark, sf_dir):
    """B7 + B13 + C7: the loan table of the combined panel: key, score and
    every ``orig*`` column, de-duplicated, key uniqueness asserted."""
    lm = T.loan_months(spark, sf_dir).select(
        "loan", "obs", "upb", F.col("score").alias("creditScore"), F.col("balance").alias("origUPB"),
        F.col("msa").alias("origNation"))
    table = CL.project_prefix(lm, "orig", keep=["loan", "creditScore"]).distinct()
    Q.assert_unique(table, ["loan"])
    return table.withColumn("origUPB", rnd("origUPB", 2))


@query("numeric_promotion", T.with_ctes("dirty_loans") + """
select cast(loan as double) as loan, score_raw, cast(first_raw as double) as first_raw,
       cast(postal_raw as double) as postal_raw, channel_raw, flag_raw, servicer,
       cast(msa as double) as msa, round(balance, 2) as balance from dirty_loans""")
def numeric_promotion(spark, sf_dir):
    """B16 + B17: numeric columns promoted to double; string columns cast
    only when every value casts (score_raw holds blanks and stays a string)."""
    d = CL.best_effort_numeric(CL.promote_numeric(T.dirty_loans(spark, sf_dir)))
    return d.withColumn("balance", rnd("balance", 2))
