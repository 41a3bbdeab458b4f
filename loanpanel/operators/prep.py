"""File preparation pipelines (L12-L15): one projection of cleaning and
encoding expressions per file, built from the B/C/D operators.

Column names follow the loan files' layout (FIXTURES.md §1); a pipeline
only touches the columns that are present, so partial files work too.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.functions.exprs import delinquency_number, parse_yyyymm, strip_float_suffix, yes_no_flag, zero_pad
from loanpanel.operators import clean as CL
from loanpanel.operators import encode as EN
from loanpanel.operators.guards import RowChecks

# Monthly money columns whose NULLs become 0.
MONTHLY_ZERO_FILL = (
    "mtgInsuranceRecovery", "nonMtgInsuranceRecovery", "expenses", "legalCosts",
    "maintenancePreservtnCosts", "taxesInsuranceOwed", "miscExpenses",
    "actualLossCalculation", "modificationCost",
)
# Monthly columns whose NULLs become the column median.
MONTHLY_MEDIAN_FILL = ("currUPB", "currInterestRate", "currDeferredUPB")
# Monthly columns parsed from yyyyMM codes.
MONTHLY_DATES = ("zeroBalanceEffectiveDate", "dueDateLastPaidInstallment")


def _finished(out: DataFrame, keep: Iterable[str] | None, checks: RowChecks | None, not_null: Iterable[str] = ()) -> DataFrame:
    """The projection (B6, columns in the order of ``keep``) and the checks at the end of a prep."""
    if keep is not None:
        out = out.select(*[F.col(f"`{c}`") for c in keep])
    return checks.watch(out, "prepared", not_null) if checks is not None else out


def prep_monthly(df: DataFrame, zero_balance_values: Iterable[str] | None = None,
                 keep: Iterable[str] | None = None, checks: RowChecks | None = None) -> DataFrame:
    """Monthly performance file -> typed, cleaned, encoded rows.

    Steps: period not NULL (B10) and parsed if still a string (D15); median
    fill (D1); delinquency number (D4); Y/N flags (D5); zero-balance decode
    and one-hot (D6/D7); date codes (D10/D15); net-sales sentinels (D14,
    testing the source column); zero fill of money columns (D3); drop the
    unnamed trailing column (B9); projection to ``keep`` (B6).  With ``checks`` the
    NULL report of the result (C4) comes with the job that writes it
    (stage "prepared")."""
    cols = set(df.columns)
    out = df
    if "mthlyRepPeriod" in cols and dict(df.dtypes)["mthlyRepPeriod"] == "string":
        out = out.withColumn("mthlyRepPeriod", parse_yyyymm("mthlyRepPeriod"))
    if "mthlyRepPeriod" in cols:
        out = out.where(F.col("mthlyRepPeriod").isNotNull())
    exprs = {}
    if "currLoanDelinqStatus" in cols:
        exprs["currLoanDelinqStatus"] = delinquency_number("currLoanDelinqStatus")
    for c in ("loanAge", "remainingMonthsLegMaturity"):
        if c in cols:
            exprs[c] = (F.col(c).cast("string")).try_cast("double")
    if "repurchaseFlag" in cols:
        exprs["repurchaseFlag"] = yes_no_flag("repurchaseFlag")
    if "modificationFlag" in cols:
        exprs["modificationFlag"] = yes_no_flag("modificationFlag")
    if "zeroBalanceCode" in cols:
        exprs["zeroBalanceCode"] = EN.decode_zero_balance("zeroBalanceCode")
    for c in MONTHLY_DATES:
        if c in cols:
            exprs[c] = parse_yyyymm(c)
    if "netSalesProceeds" in cols:
        exprs["netSalesProceeds_covered"] = F.when(F.col("netSalesProceeds") == "C", 1).otherwise(0)
        exprs["netSalesProceeds_unknown"] = F.when(F.col("netSalesProceeds") == "U", 1).otherwise(0)
    for c in MONTHLY_ZERO_FILL:
        if c in cols:
            exprs[c] = F.coalesce((F.col(c).cast("string")).try_cast("double"), F.lit(0.0))
    for c in MONTHLY_MEDIAN_FILL:
        if c in cols:
            exprs[c] = (F.col(c).cast("string")).try_cast("double")
    out = out.withColumns(exprs)
    med = [c for c in MONTHLY_MEDIAN_FILL if c in cols]
    if med:
        out = CL.median_impute(out, med)
    if "zeroBalanceCode" in cols:
        out = EN.one_hot_dynamic(out, "zeroBalanceCode", zero_balance_values, prefix="zeroBalCode")
    return _finished(CL.drop_name_patterns(out, patterns=(), exact=("Unknown", "")), keep, checks)


# Origination columns that may hold no NULL.
ORIGINATION_NOT_NULL = ("origLoanTerm", "borrowers")


def prep_origination(df: DataFrame, channel_values: Iterable[str] | None = None,
                     prepay_yes=("78", "78.0", "Y"), fill_per_column: bool = True,
                     keep: Iterable[str] | None = None, checks: RowChecks | None = None) -> DataFrame:
    """Origination file -> typed, cleaned, encoded rows.

    Steps: scores (B1-B3); first payment and maturity dates (B4, D15);
    first-time-buyer NULL -> 'N' then label-encoded (D3, D9); MSA and
    postal code suffix strip and pad (D10, D11); flags (D5, D13); blanks to
    zero (D12); median fill of CLTV per column (D2 intent); channel one-hot
    (D7); the static product/property/occupancy/purpose codes (D8); projection
    to ``keep`` (B6).  With ``checks``, ``checks.verify()`` raises after the job if an
    input column is NULL throughout (C1, stage "loaded") or the term or the borrowers
    hold a NULL (C5, stage "prepared")."""
    cols = set(df.columns)
    out = checks.watch(df, "loaded", no_all_null=True) if checks is not None else df
    if "creditScore" in cols:
        out = CL.clean_scores(out)
    exprs = {}
    for c in ("firstPaymentDate", "maturityDate"):
        if c in cols and dict(df.dtypes)[c] == "string":
            exprs[c] = parse_yyyymm(c)
    if "MSA" in cols:
        exprs["MSA"] = strip_float_suffix("MSA")
    if "postalCode" in cols:
        exprs["postalCode"] = zero_pad(strip_float_suffix("postalCode"), 5)
    if "prepayPenaltyMtgFlag" in cols:
        exprs["prepayPenaltyMtgFlag"] = yes_no_flag("prepayPenaltyMtgFlag", prepay_yes)
    if "superConformingFlag" in cols:
        exprs["superConformingFlag"] = yes_no_flag("superConformingFlag")
    for c in ("origDTI", "mtgInsurancePct"):
        if c in cols:
            exprs[c] = EN.blank_to_zero(c)
    out = out.withColumns(exprs)
    if "origCLTV" in cols and fill_per_column:
        out = CL.median_impute(out.withColumn("origCLTV", (F.col("origCLTV").cast("string")).try_cast("double")),
                               ["origCLTV"])
    if "firstTimeBuyFlag" in cols:
        out = EN.label_encode(out, "firstTimeBuyFlag", fill="N")
    if "channel" in cols:
        out = out.withColumn("channel", F.trim("channel"))
    coded = [c for c in ("channel", "occStatus", "loanPurpose", "propertyType", "propertyState") if c in cols]
    values = EN.observed_values_of(out, [c for c in coded if c != "channel" or channel_values is None])
    for c in coded:
        out = EN.one_hot_dynamic(out, c, values.get(c, channel_values))
    out = out.drop("channel")
    if "productType" in cols:
        out = EN.one_hot_static(out, "productType", EN.PRODUCT_TYPE_CODES)
    return _finished(out, keep, checks, ORIGINATION_NOT_NULL)


def prep_most_recent_month(monthly: DataFrame, key: str = "loanSeqNumber",
                           status: str = "currLoanDelinqStatus",
                           money=("currUPB", "currDeferredUPB", "modificationCost")) -> DataFrame:
    """L14 (older monthly prep): all-NULL columns dropped (C2); zero-balance
    codes one-hot by name (D8) and the code dropped; unneeded dates dropped;
    ``delinquencyFlag`` = status >= 2 or 'R' (D19); repurchase Y -> 1 (D5);
    money columns -> absolute deviation from their mean (D18); every column
    but the key suffixed ``_mostRecentMth`` (B14); unnamed columns dropped (B9)."""
    from loanpanel.operators import quality as Q
    out = Q.drop_all_null(monthly)
    if "zeroBalanceCode" in out.columns:
        code = strip_float_suffix("zeroBalanceCode").try_cast("int")
        out = out.withColumns({name: F.when(code == k, 1).otherwise(0)
                               for k, name in EN.ZERO_BALANCE_NAMES.items()}).drop("zeroBalanceCode")
    out = out.drop("dueDateLastPaidInstallment", "Unknown")
    if status in out.columns:
        s = F.col(status).cast("string")
        out = out.withColumn("delinquencyFlag",
                             F.when((s.try_cast("double") >= 2) | (F.trim(s) == "R"), 1).otherwise(0))
    if "repurchaseFlag" in out.columns:
        out = out.withColumn("repurchaseFlag", yes_no_flag("repurchaseFlag"))
    present = [c for c in money if c in out.columns]
    if present:
        out = EN.abs_deviation(out, present)
    return CL.drop_name_patterns(CL.suffix_rename(out, "_mostRecentMth", key))


def prep_origination_older(orig: DataFrame, key: str = "loanSeqNumber",
                           drop: Iterable[str] = ()) -> DataFrame:
    """L15 (older origination prep): all-NULL and constant columns dropped
    (C2, C3); loan purpose, property type, occupancy and channel one-hot by
    name with the source dropped (D8); Y/N flags (D5, D13 'Y'); listed
    columns dropped (B8); ``_origination`` suffix (B14); unnamed columns
    dropped (B9)."""
    from loanpanel.operators import quality as Q
    out = Q.drop_constant(Q.drop_all_null(orig))
    for c, codes in (("loanPurpose", EN.LOAN_PURPOSE_NAMES), ("propertyType", EN.PROPERTY_TYPE_NAMES),
                     ("occStatus", EN.OCCUPANCY_NAMES), ("channel", EN.CHANNEL_NAMES)):
        if c in out.columns:
            out = EN.one_hot_static(out, c, codes, trim=(c == "channel"), named=True, drop_source=True)
    for c in ("firstTimeBuyFlag", "prepayPenaltyMtgFlag", "superConformingFlag"):
        if c in out.columns:
            out = out.withColumn(c, yes_no_flag(c))
    out = out.drop(*[c for c in drop if c in out.columns])
    return CL.drop_name_patterns(CL.suffix_rename(out, "_origination", key))
