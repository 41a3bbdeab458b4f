"""Origination default queries (L1-L3, L11): threshold flags, first default
month and the rows before a default, on the bound panel (60 days = status 2)."""

from __future__ import annotations

from loanpanel.operators import joins as J
from loanpanel.operators import panel as P
from loanpanel.operators import quality as Q
from loanpanel.plans import driver_tables as T
from loanpanel.plans.registry import query

C = T.PANEL_COLS
DAYS = 60
THR = P.status_for_days(DAYS)
FLAG = f"delinquent_threshold_passed_{DAYS}"


@query("default_flag", T.with_ctes("panel", "loans") + f""",
f as (select loan, max(case when status >= {THR} then 1 else 0 end) as flag from panel group by loan)
select l.loan, coalesce(f.flag, 0) as {FLAG} from loans l left join f using (loan)""")
def default_flag(spark, sf_dir):
    out = P.create_default_flag(T.loans(spark, sf_dir).select("loan"), T.panel(spark, sf_dir), C, DAYS)
    return out.select("loan", FLAG)


_FIRST_SQL = f"""fd as (select loan, min(d) as firstDefaultMth_literal,
                   min(case when status >= {THR} then d end) as firstDefaultMth
            from panel group by loan having min(case when status >= {THR} then d end) is not null)"""


@query("first_default_month", T.with_ctes("panel") + ",\n" + _FIRST_SQL + """
select loan, firstDefaultMth_literal, firstDefaultMth from fd""")
def first_default_month(spark, sf_dir):
    return P.first_default_month(T.panel(spark, sf_dir), C, DAYS) \
        .select("loan", "firstDefaultMth_literal", "firstDefaultMth")


@query("prior_default_rows", T.with_ctes("panel") + f""",
r as (select p.*, row_number() over w - 1 as pos,
             lead(case when status >= {THR} then 1 else 0 end, 1) over w as n1,
             lead(case when status >= {THR} then 1 else 0 end, 2) over w as n2
      from panel p where loan in (select loan from panel where status >= {THR})
      window w as (partition by loan order by d, obs)),
m as (select *, case when n2 = 1 then 1 else 0 end as prior_mth,
             case when pos > 0 and n1 = 1 then 2 when n2 = 1 then 1 else 0 end as mark from r)
select loan, obs, d, status, prior_mth, mark, mark not in (1, 2) as kept from m""")
def prior_default_rows(spark, sf_dir):
    p = P.prior_default_rows(T.panel(spark, sf_dir), C, DAYS)
    return p.select("loan", "obs", "d", "status", "prior_mth", "mark", "kept")


@query("origination_default_table", T.with_ctes("panel", "loans") + ",\n" + _FIRST_SQL + f""",
f as (select loan, max(case when status >= {THR} then 1 else 0 end) as flag from panel group by loan)
select l.loan, l.servicer, l.msa, l.score, l.balance, coalesce(f.flag, 0) as {FLAG},
       fd.firstDefaultMth_literal, fd.firstDefaultMth
from loans l left join f using (loan) left join fd using (loan)
where l.loan in (select loan from panel)""")
def origination_default_table(spark, sf_dir):
    """E5 (loans present in both tables) -> C9 (drop homogeneous
    columns) -> L1 (flag) -> L2 (first default months, left-joined)."""
    loans, months = J.semi_both(T.loans(spark, sf_dir), T.panel(spark, sf_dir), "loan")
    loans = Q.remove_homogeneity(loans, 0.99, columns=["servicer", "msa", "score", "balance"])
    flagged = P.create_default_flag(loans, months, C, DAYS)
    first = P.first_default_month(months, C, DAYS)
    out = J.add_loan_features(flagged, first, "loan")
    return out.select("loan", *[c for c in ("servicer", "msa", "score", "balance") if c in out.columns],
                      FLAG, "firstDefaultMth_literal", "firstDefaultMth")


