"""Loan-panel features over time.

A panel holds one row per loan and reporting period.  All operators take
column names through :class:`PanelCols`, so the same code runs on the
monthly performance files and on any table bound to those roles.

Scale design
------------
* Ranks (G1) and the history/target split (L4) are computed on the
  *(loan, period)* level: the panel is first pre-aggregated map-side to one
  row per loan and period, so the ordered window only ever sees distinct
  periods of a loan (bounded by the calendar, not by the row count).
* Row-level work (percentiles, variance, rolling frames) gets the period
  facts back through an equi-join on *(loan, period)*; hashing on both keys
  spreads even a very large loan over many tasks.
* A row's position in its loan comes from segments of the order (see
  ``functions/segments``): rows are counted per (loan, period, segment), a
  window over these counts gives each segment's carry, and only the rows of
  one segment are numbered together.  A (loan, period) that holds a third
  of all rows is spread over a third of the segments.
* Rolling frames of given widths (G8) run over fixed-size chunks of a loan's
  ordered rows; each chunk also receives the ``max_width - 1`` rows before it
  (a halo) so frames that cross a chunk boundary are complete.  All widths
  together (L9) come from doubling levels (``operators/widths``).  No task
  ever holds a whole loan.
* Quartiles per loan are read by rank from the same kind of segments, not
  from a merged map of the loan's values.
* Loan-level results come from one ``groupBy(loan)`` with conditional
  aggregates (partial aggregation before the shuffle), never from joins of
  several per-feature aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.functions.segments import grouped_quantiles, with_segment
from loanpanel.operators.widths import DEFAULT_BLOCK_ROWS, series_measures
from loanpanel.session import cut_lineage


DEFAULT_WINDOW_MONTHS = 3
DEFAULT_CHUNK_ROWS = 1_000_000


@dataclass(frozen=True)
class PanelCols:
    """Role -> column name for a loan panel."""
    loan: str = "loanSeqNumber"
    period: str = "mthlyRepPeriod"
    upb: str = "currUPB"
    status: str = "currLoanDelinqStatus"
    # deterministic order among rows of one loan that share a period
    tiebreak: str | None = None


def _order_within_period(cols: PanelCols) -> list[Column]:
    if cols.tiebreak:
        return [F.col(cols.tiebreak)]
    return [F.col(cols.upb), F.col(cols.status)]


# --------------------------------------------------------------------------
# G1 / G2 / L4 on the (loan, period) level
# --------------------------------------------------------------------------

def period_level(panel: DataFrame, cols: PanelCols = PanelCols(),
                 window_months: int = DEFAULT_WINDOW_MONTHS) -> DataFrame:
    """One row per (loan, period) with rank facts and per-period summaries.

    Columns: loan, period, ``n_rows``, ``rows_before`` (rows of the loan in
    earlier periods), ``mth_of_loan`` (rank, ties share the minimum),
    ``loan_months_total`` (highest rank of the loan), ``in_history``
    (``mth_of_loan < loan_months_total - window_months``; the target window
    is the rest, i.e. the last ``window_months + 1`` ranks), and per-period
    ``max_status``, ``n_status_pos``, ``min_upb``, ``max_upb``.
    """
    per = (panel
           .where(F.col(cols.loan).isNotNull() & F.col(cols.period).isNotNull())
           .groupBy(cols.loan, cols.period)
           .agg(F.count(F.lit(1)).alias("n_rows"),
                F.max(cols.status).alias("max_status"),
                F.count(F.when(F.col(cols.status) > 0, True)).alias("n_status_pos"),
                F.min(cols.upb).alias("min_upb"),
                F.max(cols.upb).alias("max_upb")))
    w_ord = Window.partitionBy(cols.loan).orderBy(cols.period)
    before = F.coalesce(F.sum("n_rows").over(w_ord.rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0)).cast("long")
    return _rank_facts(per.withColumn("rows_before", before), cols, window_months)


def _rank_facts(per: DataFrame, cols: PanelCols, window_months: int) -> DataFrame:
    """Rank and loan-wide facts from rows of (loan, period, ...) with ``rows_before``, ``n_rows`` and ``max_status``."""
    w_all = Window.partitionBy(cols.loan)
    per = per.withColumn("mth_of_loan", (F.col("rows_before") + 1).cast("int"))
    per = per.withColumn("loan_months_total", F.max("mth_of_loan").over(w_all))
    per = (per.withColumn("loan_rows", F.sum("n_rows").over(w_all))
              .withColumn("loan_max_status", F.max("max_status").over(w_all))
              .withColumn("loan_first_period", F.min(cols.period).over(w_all)))
    return per.withColumn(
        "in_history", F.col("mth_of_loan") < F.col("loan_months_total") - F.lit(window_months))


def segment_level(rows: DataFrame, cols: PanelCols = PanelCols(),
                  window_months: int = DEFAULT_WINDOW_MONTHS) -> DataFrame:
    """The facts of :func:`period_level` per (loan, period, ``_seg``), with
    ``rows_ahead`` (rows of the loan before the segment) and ``history_rows``
    (rows of the loan that are history).  The windows see one row per
    (period, segment) of a loan that has rows there."""
    seg = rows.groupBy(cols.loan, cols.period, "_seg").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(cols.status).alias("max_status"))
    w_ord = Window.partitionBy(cols.loan).orderBy(cols.period, "_seg")
    ahead = F.coalesce(F.sum("n_rows").over(w_ord.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seg = seg.withColumn("rows_ahead", ahead.cast("long"))
    seg = seg.withColumn("rows_before", F.min("rows_ahead").over(Window.partitionBy(cols.loan, cols.period)))
    seg = _rank_facts(seg, cols, window_months)
    return seg.withColumn("history_rows", F.sum(F.when(F.col("in_history"), F.col("n_rows")).otherwise(0))
                                           .over(Window.partitionBy(cols.loan)))


def ranked_rows(panel: DataFrame, cols: PanelCols = PanelCols(),
                window_months: int = DEFAULT_WINDOW_MONTHS, with_pos: bool = True,
                segments: int | None = None) -> DataFrame:
    """G1 + G2 + L4 at row level: every panel row with its period facts.

    Adds ``mth_of_loan``, ``loan_months_total``, ``in_history`` and, with
    ``with_pos``, ``pos`` (0-based position of the row in the loan's
    (period, tiebreak) order) and ``history_rows``.  Positions come from
    segments of the tiebreak (``segments`` of them; the session's number of
    shuffle partitions by default), so no task sorts a whole (loan, period).
    """
    rows = panel.where(F.col(cols.loan).isNotNull() & F.col(cols.period).isNotNull())
    facts = ["mth_of_loan", "loan_months_total", "in_history", "loan_rows", "loan_max_status", "loan_first_period"]
    if not with_pos:
        per = period_level(panel, cols, window_months).select(cols.loan, cols.period, *facts)
        return rows.join(per, [cols.loan, cols.period], "inner")
    order = _order_within_period(cols)
    rows = with_segment(rows, cols.tiebreak or cols.upb, "_seg", segments)
    unit = [cols.loan, cols.period, "_seg"]
    seg = segment_level(rows, cols, window_months).select(*unit, "rows_ahead", "history_rows", *facts)
    inside = Window.partitionBy(*unit).orderBy(*order)
    return (rows.join(seg, unit, "inner")
                .withColumn("pos", F.col("rows_ahead") + F.row_number().over(inside) - 1)
                .drop("rows_ahead", "_seg"))


def history_target_split(panel: DataFrame, cols: PanelCols = PanelCols(),
                         window_months: int = DEFAULT_WINDOW_MONTHS) -> DataFrame:
    """L4: label each row 'history' or 'target' (history ∪ target = panel)."""
    r = ranked_rows(panel, cols, window_months, with_pos=False)
    return r.withColumn("window", F.when(F.col("in_history"), "history").otherwise("target")) \
            .drop("in_history")


# --------------------------------------------------------------------------
# Loan-level features from the period level (no row-level join needed)
# --------------------------------------------------------------------------

def add_target(per: DataFrame, cols: PanelCols = PanelCols()) -> DataFrame:
    """L5 from :func:`period_level`: ``default_in_window`` per loan."""
    return per.groupBy(cols.loan).agg(
        F.when(F.max(F.when(~F.col("in_history"), F.col("max_status"))) > 0, 1)
         .otherwise(0).alias("default_in_window"))


def add_prev_defaults(per: DataFrame, cols: PanelCols = PanelCols()) -> DataFrame:
    """``prev_defaults`` (0/1 any default in history), ``prev_defaults_sum``
    (the source's sum over an already-collapsed frame, equal to the flag) and
    ``months_in_default`` (what its comment means: history rows in default).
    Loans without history rows get NULL, as in the source's left merge."""
    h = per.where("in_history")
    flag = F.when(F.max("max_status") > 0, 1).otherwise(0)
    return h.groupBy(cols.loan).agg(
        flag.alias("prev_defaults"),
        flag.cast("long").alias("prev_defaults_sum"),
        F.sum("n_status_pos").cast("long").alias("months_in_default"))


def add_loan_age(per: DataFrame, cols: PanelCols = PanelCols()) -> DataFrame:
    """Mean ``loan_months_total`` over history rows (the constant itself)."""
    h = per.where("in_history")
    return h.groupBy(cols.loan).agg(
        (F.sum(F.col("loan_months_total") * F.col("n_rows")) / F.sum("n_rows"))
        .cast("double").alias("loan_months_total"))


# --------------------------------------------------------------------------
# Row-level features
# --------------------------------------------------------------------------

def _with_chunks(ranked: DataFrame, cols: PanelCols, max_width: int,
                 chunk_rows: int, halo_after: int = 0) -> DataFrame:
    """Assign rows to chunks of ``chunk_rows`` consecutive positions of a loan.

    A row is also copied into every later chunk whose first frame reaches
    back to it (``max_width - 1`` rows) and into every earlier chunk whose
    last rows look ahead to it (``halo_after`` rows); ``owned`` is false on
    the copies."""
    halo = max(max_width - 1, 0)
    pos = F.col("pos")
    size = F.lit(chunk_rows)
    chunk = F.floor(pos / size)
    first = F.greatest(F.floor((pos - F.lit(halo_after)) / size), F.lit(0)) if halo_after else chunk
    last = F.floor((pos + F.lit(halo)) / size) if halo else chunk
    return (ranked.withColumn("_chunk", chunk)
                  .withColumn("_part", F.explode(F.sequence(first, last)))
                  .withColumn("owned", F.col("_part") == F.col("_chunk"))
                  .drop("_chunk"))


def _rolling_rates(chunked: DataFrame, cols: PanelCols, widths) -> DataFrame:
    """``(rolling max - rolling min) / m`` over full frames of m rows."""
    w = Window.partitionBy(cols.loan, "_part").orderBy("pos")
    out = chunked
    for m in widths:
        frame = w.rowsBetween(-(m - 1), 0)
        full = F.count(cols.upb).over(frame) == m
        rate = (F.max(cols.upb).over(frame) - F.min(cols.upb).over(frame)) / F.lit(float(m))
        out = out.withColumn(f"_rate_{m}", F.when(full, rate))
    return out


_QUARTILES = {"__p25": 0.25, "__p75": 0.75}


def _variability_aggs(hist: Column, cols: PanelCols) -> list[Column]:
    upb = F.when(hist, F.col(cols.upb))
    return [(F.max(upb) - F.min(upb)).alias("loan_Range"), F.var_samp(upb).alias("UPB_var")]


def _loan_iqr(history: DataFrame, cols: PanelCols, segments: int | None = None) -> DataFrame:
    """(loan, ``loan_IQR``) of the loans with a balance among their history rows."""
    q = grouped_quantiles(history, [cols.loan], cols.upb, _QUARTILES, segments)
    return q.select(cols.loan, (F.col("__p75") - F.col("__p25")).alias("loan_IQR"))


def add_variability_measures(panel: DataFrame, cols: PanelCols = PanelCols(),
                             window_months: int = DEFAULT_WINDOW_MONTHS,
                             segments: int | None = None) -> DataFrame:
    """``loan_IQR`` (exact linear-interpolated quartiles, read by rank), ``loan_Range``
    and ``UPB_var`` (sample variance) of history balances per loan."""
    r = cut_lineage(ranked_rows(panel, cols, window_months, with_pos=False).where("in_history").select(cols.loan, cols.upb))
    spread = r.groupBy(cols.loan).agg(*_variability_aggs(F.lit(True), cols))
    return spread.join(_loan_iqr(r, cols, segments), cols.loan, "left").select(cols.loan, "loan_IQR", "loan_Range", "UPB_var")


def add_upb_max_change_rate(panel: DataFrame, cols: PanelCols = PanelCols(),
                            window_months: int = DEFAULT_WINDOW_MONTHS,
                            widths=(1, 2, 3), chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Per width m, the loan's max of (rolling max - rolling min)/m over
    full frames of history rows -> ``max_upb_change_rate_<m>``."""
    widths = list(widths)
    r = ranked_rows(panel, cols, window_months).where("in_history")
    ch = _rolling_rates(_with_chunks(r, cols, max(widths), chunk_rows), cols, widths)
    owned = F.col("owned")
    return ch.groupBy(cols.loan).agg(*[
        F.max(F.when(owned, F.col(f"_rate_{m}"))).alias(f"max_upb_change_rate_{m}") for m in widths])


def _series_by_loan(history: DataFrame, cols: PanelCols, block_rows: int, segments: int | None) -> DataFrame:
    """(loan, ``__rates``, ``max_upb_change_rates``, ``loan_IQR``) of the history rows.  Element m - 1 of the
    two arrays is the rate of width m, for all widths that the loan has rows for, and for those up to M - 1
    (M = most history rows of any loan, a subquery of the same plan)."""
    rows = history.select(F.col(cols.loan).alias("loan"), "pos", F.col(cols.upb).alias("upb"), F.col("history_rows").alias("n"))
    found = series_measures(rows, list(_QUARTILES.values()), block_rows, segments)
    widest = history.agg(F.max("history_rows") - 1).scalar()
    return found.select(F.col("loan").alias(cols.loan), F.col("rates").alias("__rates"),
                        F.slice("rates", F.lit(1), widest.cast("int")).alias("max_upb_change_rates"),
                        (F.get("quantiles", F.lit(1)) - F.get("quantiles", F.lit(0))).alias("loan_IQR"))


def upb_change_rate_all_widths(panel: DataFrame, cols: PanelCols = PanelCols(),
                               window_months: int = DEFAULT_WINDOW_MONTHS,
                               chunk_rows: int = DEFAULT_BLOCK_ROWS, segments: int | None = None) -> DataFrame:
    """L9 as the source computes it: every width 1..M-1 (M = most history rows
    of any loan), returned long as (loan, width, max_upb_change_rate) for the
    widths a loan has enough history rows for.  The plan is the same for every M."""
    r = ranked_rows(panel, cols, window_months, segments=segments).where("in_history")
    history = cut_lineage(r.select(cols.loan, "pos", cols.upb, "history_rows"))
    by_loan = _series_by_loan(history, cols, chunk_rows, segments)
    long = by_loan.select(cols.loan, F.posexplode("max_upb_change_rates").alias("__m", "max_upb_change_rate"))
    return (long.where(F.col("max_upb_change_rate").isNotNull())
                .select(cols.loan, (F.col("__m") + 1).alias("width"), "max_upb_change_rate"))


def all_widths(panel: DataFrame, cols: PanelCols = PanelCols(),
               window_months: int = DEFAULT_WINDOW_MONTHS) -> list[int]:
    """The source's width list 1..M-1, M = most history rows of any loan
    (one small aggregate action)."""
    per = period_level(panel, cols, window_months).where("in_history")
    m = per.groupBy(cols.loan).agg(F.sum("n_rows").alias("n")).agg(F.max("n")).first()[0]
    return list(range(1, int(m or 0)))


def loan_feature_table(panel: DataFrame, loans: DataFrame, cols: PanelCols = PanelCols(),
                       window_months: int = DEFAULT_WINDOW_MONTHS, widths=(1, 2, 3),
                       drop_incomplete: bool = False, chunk_rows: int = DEFAULT_BLOCK_ROWS,
                       segments: int | None = None) -> DataFrame:
    """The loan feature table.

    ``loans`` carries the loan-level columns (score, origination columns);
    loans without panel rows are dropped, as the source builds its loan
    list from the joined panel.  ``max_upb_change_rates`` holds the rate of
    every width 1..M-1 that the loan has rows for; ``widths`` also come as
    columns ``max_upb_change_rate_<m>``.  ``drop_incomplete`` applies the
    source's listwise deletion (B11) to all columns but that array.

    The ranked rows are staged once; flags, quartiles and rates are read from it.
    """
    widths = list(widths)
    r = cut_lineage(ranked_rows(panel, cols, window_months, segments=segments)
                    .select(cols.loan, cols.status, cols.upb, "in_history", "loan_months_total", "pos", "history_rows"))
    history = r.where("in_history")
    hist, tgt = F.col("in_history"), ~F.col("in_history")
    prev_flag = F.when(F.max(F.when(hist, F.col(cols.status))) > 0, 1) \
                 .when(F.count(F.when(hist, True)) > 0, 0)
    feats = r.groupBy(cols.loan).agg(
        F.when(F.max(F.when(tgt, F.col(cols.status))) > 0, 1).otherwise(0).alias("default_in_window"),
        prev_flag.alias("prev_defaults"),
        prev_flag.cast("long").alias("prev_defaults_sum"),
        F.when(F.count(F.when(hist, True)) > 0,
               F.count(F.when(hist & (F.col(cols.status) > 0), True))).alias("months_in_default"),
        F.avg(F.when(hist, F.col("loan_months_total"))).alias("loan_months_total"),
        *_variability_aggs(hist, cols),
    )
    feats = feats.join(_series_by_loan(history, cols, chunk_rows, segments), cols.loan, "left")
    feats = feats.select(
        cols.loan, "default_in_window", "prev_defaults", "prev_defaults_sum", "months_in_default", "loan_months_total",
        "loan_IQR", "loan_Range", "UPB_var",
        *[F.get("__rates", F.lit(m - 1)).alias(f"max_upb_change_rate_{m}") for m in widths],
        "max_upb_change_rates")
    out = loans.join(feats, cols.loan, "inner")
    return out.dropna("any", subset=[c for c in out.columns if c != "max_upb_change_rates"]) if drop_incomplete else out


# --------------------------------------------------------------------------
# Default flags and months
# --------------------------------------------------------------------------

# Delinquency status -> days-past-due bucket label, as the source names them.
DELINQUENCY_BUCKETS = {
    0: "0_29days_delinquent",
    1: "30_59days delinquent",
    2: "60_89days delinquent",
    3: "90_119days delinquent",
    4: "120_149days delinquent",
    5: "150_179days_delinquent",
    6: "180_209days_delinquent",
    7: "210_plus",
}
ALLOWED_DELINQ_DAYS = (30, 60, 90, 120)


def status_for_days(delinq_days_min: int) -> int:
    """Status number whose bucket label names ``delinq_days_min`` days (60 -> 2)."""
    if delinq_days_min not in ALLOWED_DELINQ_DAYS:
        raise ValueError(f"delinq_days_min must be one of {ALLOWED_DELINQ_DAYS}")
    hits = [k for k, label in DELINQUENCY_BUCKETS.items() if label.startswith(f"{delinq_days_min}_")]
    if len(hits) != 1:
        raise ValueError("delinquency bucket labels overlap")
    return hits[0]


def create_default_flag(loans: DataFrame, monthly: DataFrame, cols: PanelCols = PanelCols(),
                        delinq_days_min: int = 60) -> DataFrame:
    """L1: loan flag ``delinquent_threshold_passed_<d>`` = any month with
    status >= the status for ``delinq_days_min`` days; 0 for loans without months."""
    thr = status_for_days(delinq_days_min)
    name = f"delinquent_threshold_passed_{delinq_days_min}"
    flags = monthly.groupBy(cols.loan).agg(
        F.max(F.when(F.col(cols.status) >= thr, 1).otherwise(0)).alias(name))
    return loans.join(flags, cols.loan, "left").fillna({name: 0})


def first_default_month(monthly: DataFrame, cols: PanelCols = PanelCols(),
                        delinq_days_min: int = 60) -> DataFrame:
    """L2: per loan that ever crossed the threshold, ``firstDefaultMth_literal``
    (its first reporting month, as the source computes) and
    ``firstDefaultMth`` (its first month at or past the threshold)."""
    thr = status_for_days(delinq_days_min)
    crossed = F.col(cols.status) >= thr
    g = monthly.where(F.col(cols.period).isNotNull()).groupBy(cols.loan).agg(
        F.min(cols.period).alias("firstDefaultMth_literal"),
        F.min(F.when(crossed, F.col(cols.period))).alias("firstDefaultMth"))
    return g.where(F.col("firstDefaultMth").isNotNull())


def prior_default_rows(monthly: DataFrame, cols: PanelCols = PanelCols(),
                       delinq_days_min: int = 60, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """L3 on the loans that ever crossed the threshold.

    ``prior_mth`` is 1 on a row whose loan crosses the threshold two rows
    later (G10: lead 2 within the loan); ``mark`` repeats that and then turns
    the row right after a marked row into 2 (G11, one pass).  The source's two
    outputs are ``prior_mth == 1`` (month before target) and ``mark not in
    (1, 2)`` (flag ``kept``).

    Leads are read by row position inside chunks of the loan, each chunk
    also holding the first two rows of the next one, so no task holds a
    whole loan."""
    thr = status_for_days(delinq_days_min)
    # loans that ever crossed: a loan-wide max from the period table, joined on
    # (loan, period) with the ranks, so a hot loan is never routed to one task
    r = (ranked_rows(monthly, cols).where(F.col("loan_max_status") >= thr)
         .drop("in_history", "mth_of_loan", "loan_months_total", "loan_rows", "loan_max_status",
               "loan_first_period", "history_rows"))
    ch = _with_chunks(r, cols, 1, chunk_rows, halo_after=2)
    w = Window.partitionBy(cols.loan, "_part").orderBy("pos")
    crossed = F.when(F.col(cols.status) >= thr, 1).otherwise(0)
    nxt1 = F.lead(crossed, 1).over(w)
    nxt2 = F.lead(crossed, 2).over(w)
    prior = F.when(nxt2 == 1, 1).otherwise(0)
    mark = F.when((F.col("pos") > 0) & (nxt1 == 1), 2).otherwise(prior)
    out = ch.withColumn("prior_mth", prior).withColumn("mark", mark).where("owned")
    return out.drop("_part", "owned").withColumn("kept", ~F.col("mark").isin(1, 2))


def loan_wide(monthly: DataFrame, cols: PanelCols = PanelCols()) -> DataFrame:
    """G3, G6, G7 on every row: ``months_in_loan``, ``any_default`` (max
    status > 0) and ``first_month``.

    The loan-wide values are windows over the loan's periods (the
    pre-aggregated period table) and reach the rows through the
    (loan, period) join, so even a very large loan is spread over tasks."""
    r = ranked_rows(monthly, cols, with_pos=False)
    out = (r.withColumn("months_in_loan", F.col("loan_rows"))
            .withColumn("any_default", F.when(F.col("loan_max_status") > 0, 1).otherwise(0))
            .withColumn("first_month", F.col("loan_first_period")))
    return out.drop("mth_of_loan", "loan_months_total", "in_history", "loan_rows", "loan_max_status",
                    "loan_first_period")
