"""Panel queries: ranks, history/target split and loan features."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanpanel.functions.exprs import rnd
from loanpanel.operators import panel as P
from loanpanel.plans import driver_tables as T
from loanpanel.plans.registry import query

C = T.PANEL_COLS
WIDTHS = (1, 2, 3)


def _rates_text(rates: str = "max_upb_change_rates"):
    """The rates of all widths as one text, four decimals each."""
    return F.array_join(F.transform(rates, lambda x: rnd(x, 4).cast("decimal(20, 4)").cast("string")), ",").alias("rates")


# every frame of every width from each position backwards, as the oracle reads them
_ALL_WIDTHS_SQL = """,
hp as (select loan, upb, row_number() over (partition by loan order by d, obs) - 1 as pos from t where in_history),
pr as (select a.loan, a.pos as p, b.pos as q, b.upb from hp a join hp b on a.loan = b.loan and b.pos <= a.pos),
aw as (select loan, p - q + 1 as width,
              max(upb) over (partition by loan, p order by q desc rows between unbounded preceding and current row) as hi,
              min(upb) over (partition by loan, p order by q desc rows between unbounded preceding and current row) as lo
       from pr),
rw as (select loan, width, cast(round(max((hi - lo) / width), 4) as decimal(20, 4)) as rate
       from aw where width <= (select max(n) - 1 from (select count(*) as n from hp group by loan))
       group by loan, width),
rl as (select loan, string_agg(cast(rate as varchar), ',' order by width) as rates from rw group by loan)"""

# Row-level rank facts as the oracle states them: rank() and max() windows
# straight on the rows (the Spark side pre-aggregates to (loan, d) first).
_RANKED_SQL = """,
r as (select *, rank() over (partition by loan order by d) as mth_of_loan from panel),
t as (select *, max(mth_of_loan) over (partition by loan) as loan_months_total,
             mth_of_loan < max(mth_of_loan) over (partition by loan) - 3 as in_history from r)"""


@query("default_in_window", T.with_ctes("panel") + _RANKED_SQL + """
select loan,
       case when max(case when not in_history then status end) > 0 then 1 else 0 end as default_in_window
from t group by loan""")
def default_in_window(spark, sf_dir):
    per = P.period_level(T.panel(spark, sf_dir), C)
    return P.add_target(per, C)


@query("history_target_split", T.with_ctes("panel") + _RANKED_SQL + """
select loan, obs, d, cast(mth_of_loan as int) as mth_of_loan, cast(loan_months_total as int) as loan_months_total,
       case when in_history then 'history' else 'target' end as segment
from t""")
def history_target_split(spark, sf_dir):
    s = P.history_target_split(T.panel(spark, sf_dir), C)
    return s.select("loan", "obs", "d", "mth_of_loan", "loan_months_total",
                    F.col("window").alias("segment"))


@query("prev_defaults", T.with_ctes("panel") + _RANKED_SQL + """
select loan,
       case when max(status) > 0 then 1 else 0 end as prev_defaults,
       cast(case when max(status) > 0 then 1 else 0 end as bigint) as prev_defaults_sum,
       cast(count(case when status > 0 then 1 end) as bigint) as months_in_default
from t where in_history group by loan""")
def prev_defaults(spark, sf_dir):
    per = P.period_level(T.panel(spark, sf_dir), C)
    return P.add_prev_defaults(per, C)


@query("loan_age", T.with_ctes("panel") + _RANKED_SQL + """
select loan, round(avg(loan_months_total), 4) as loan_months_total
from t where in_history group by loan""")
def loan_age(spark, sf_dir):
    per = P.period_level(T.panel(spark, sf_dir), C)
    a = P.add_loan_age(per, C)
    return a.select("loan", rnd("loan_months_total", 4).alias("loan_months_total"))


@query("upb_variability", T.with_ctes("panel") + _RANKED_SQL + """
select loan,
       round(quantile_cont(upb, 0.75) - quantile_cont(upb, 0.25), 4) as loan_IQR,
       round(max(upb) - min(upb), 2) as loan_Range,
       round(var_samp(upb), 0) as UPB_var
from t where in_history group by loan""")
def upb_variability(spark, sf_dir):
    v = P.add_variability_measures(T.panel(spark, sf_dir), C)
    return v.select("loan", rnd("loan_IQR", 4).alias("loan_IQR"),
                    rnd("loan_Range", 2).alias("loan_Range"), rnd("UPB_var", 0).alias("UPB_var"))


def _rolling_sql(widths, where: str) -> str:
    frames = ",\n".join(
        f"  case when count(upb) over w{m} = {m} then (max(upb) over w{m} - min(upb) over w{m}) / {m}.0 end as rate_{m}"
        for m in widths)
    wins = ", ".join(
        f"w{m} as (partition by loan order by d, obs rows between {m - 1} preceding and current row)"
        for m in widths)
    return f""",
h as (select * from t where {where}),
rr as (select loan,
{frames}
  from h window {wins})"""


@query("upb_change_rate", T.with_ctes("panel") + _RANKED_SQL + _rolling_sql(WIDTHS, "in_history") + """
select loan, """ + ", ".join(f"round(max(rate_{m}), 4) as max_upb_change_rate_{m}" for m in WIDTHS) + """
from rr group by loan""")
def upb_change_rate(spark, sf_dir):
    r = P.add_upb_max_change_rate(T.panel(spark, sf_dir), C, widths=WIDTHS)
    return r.select("loan", *[rnd(f"max_upb_change_rate_{m}", 4).alias(f"max_upb_change_rate_{m}")
                              for m in WIDTHS])


_FEATURE_SQL = T.with_ctes("panel", "loans") + _RANKED_SQL + _rolling_sql(WIDTHS, "in_history") + """,
tg as (select loan, case when max(case when not in_history then status end) > 0 then 1 else 0 end
              as default_in_window from t group by loan),
hs as (select loan,
              case when max(status) > 0 then 1 else 0 end as prev_defaults,
              cast(case when max(status) > 0 then 1 else 0 end as bigint) as prev_defaults_sum,
              cast(count(case when status > 0 then 1 end) as bigint) as months_in_default,
              avg(loan_months_total) as loan_months_total,
              quantile_cont(upb, 0.75) - quantile_cont(upb, 0.25) as loan_IQR,
              max(upb) - min(upb) as loan_Range,
              var_samp(upb) as UPB_var
       from t where in_history group by loan),
rt as (select loan, """ + ", ".join(f"max(rate_{m}) as max_upb_change_rate_{m}" for m in WIDTHS) + """
       from rr group by loan)""" + _ALL_WIDTHS_SQL

FEATURE_SELECT = """
select l.loan, l.score, tg.default_in_window, hs.prev_defaults, hs.prev_defaults_sum, hs.months_in_default,
       round(hs.loan_months_total, 4) as loan_months_total, round(hs.loan_IQR, 4) as loan_IQR,
       round(hs.loan_Range, 2) as loan_Range, round(hs.UPB_var, 0) as UPB_var, """ + ", ".join(
    f"round(rt.max_upb_change_rate_{m}, 4) as max_upb_change_rate_{m}" for m in WIDTHS) + """
from loans l join tg using (loan) left join hs using (loan) left join rt using (loan)"""
# with the rates of all widths
ALL_WIDTHS_SELECT = FEATURE_SELECT.replace("\nfrom loans l", ", rl.rates\nfrom loans l") + " left join rl using (loan)"

FEATURE_PREFIX = _FEATURE_SQL
# the loan feature table as a named relation ``feat`` for queries built on it
FEATURE_CTE = FEATURE_PREFIX + ",\nfeat as (" + FEATURE_SELECT + ")"


@query("loan_features", FEATURE_PREFIX + ALL_WIDTHS_SELECT)
def loan_features(spark, sf_dir):
    loans = T.loans(spark, sf_dir).select("loan", "score")
    f = P.loan_feature_table(T.panel(spark, sf_dir), loans, C, widths=WIDTHS)
    return f.select(
        "loan", "score", "default_in_window", "prev_defaults", "prev_defaults_sum", "months_in_default",
        rnd("loan_months_total", 4).alias("loan_months_total"), rnd("loan_IQR", 4).alias("loan_IQR"),
        rnd("loan_Range", 2).alias("loan_Range"), rnd("UPB_var", 0).alias("UPB_var"),
        *[rnd(f"max_upb_change_rate_{m}", 4).alias(f"max_upb_change_rate_{m}") for m in WIDTHS], _rates_text())


@query("loan_row_flags", T.with_ctes("panel") + """
select loan, obs, count(*) over (partition by loan) as months_in_loan,
       case when max(status) over (partition by loan) > 0 then 1 else 0 end as any_default,
       min(d) over (partition by loan) as first_month
from panel""")
def loan_row_flags(spark, sf_dir):
    """G3 + G6 + G7: loan-wide count, any-default flag and first month on
    every row (one partial aggregate joined back by loan)."""
    p = T.panel(spark, sf_dir)
    return P.loan_wide(p, C).select("loan", "obs", "months_in_loan", "any_default", "first_month")


_EVENT_FEATURE_SQL = (FEATURE_PREFIX.replace(T.with_ctes("panel", "loans"),
                                             "with " + T.EVENT_PANEL_SQL + ",\nloans as (select distinct loan from panel)")
                      + ALL_WIDTHS_SELECT.replace("select l.loan, l.score,", "select l.loan,"))


@query("event_panel_features", _EVENT_FEATURE_SQL)
def event_panel_features(spark, sf_dir):
    """L10 on the deeper panel (users' events; heavy ties within a day)."""
    p = T.event_panel(spark, sf_dir)
    users = p.select("loan").distinct()
    f = P.loan_feature_table(p, users, C, widths=WIDTHS)
    return f.select(
        "loan", "default_in_window", "prev_defaults", "prev_defaults_sum", "months_in_default",
        rnd("loan_months_total", 4).alias("loan_months_total"), rnd("loan_IQR", 4).alias("loan_IQR"),
        rnd("loan_Range", 2).alias("loan_Range"), rnd("UPB_var", 0).alias("UPB_var"),
        *[rnd(f"max_upb_change_rate_{m}", 4).alias(f"max_upb_change_rate_{m}") for m in WIDTHS], _rates_text())


@query("upb_change_rate_all", T.with_ctes("panel") + _RANKED_SQL + """,
h as (select loan, upb, row_number() over (partition by loan order by d, obs) - 1 as pos
      from t where in_history),
pr as (select a.loan, a.pos as p, b.pos as q, b.upb from h a join h b on a.loan = b.loan and b.pos <= a.pos),
c as (select loan, p, p - q + 1 as width,
             max(upb) over (partition by loan, p order by q desc rows between unbounded preceding and current row) as hi,
             min(upb) over (partition by loan, p order by q desc rows between unbounded preceding and current row) as lo
      from pr)
select loan, cast(width as int) as width, round(max((hi - lo) / width), 4) as max_upb_change_rate
from c where width <= (select max(n) - 1 from (select count(*) as n from h group by loan))
group by loan, width""")
def upb_change_rate_all(spark, sf_dir):
    """L9 literal: every width 1..M-1, long format (loan, width, rate)."""
    r = P.upb_change_rate_all_widths(T.panel(spark, sf_dir), C)
    return r.select("loan", "width", rnd("max_upb_change_rate", 4).alias("max_upb_change_rate"))
