"""Column layouts of the loan files (all read as strings, typed afterwards)."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

# Origination file columns, in file order.
ORIGINATION_COLUMNS = [
    "creditScore", "firstPaymentDate", "firstTimeBuyFlag", "maturityDate",
    "MSA", "mtgInsurancePct", "numberUnits", "occStatus", "origCLTV",
    "origDTI", "origUPB", "origLTV", "origInterestRate", "channel",
    "prepayPenaltyMtgFlag", "productType", "propertyState", "propertyType",
    "postalCode", "loanSeqNumber", "loanPurpose", "origLoanTerm", "borrowers",
    "sellerName", "servicerName", "superConformingFlag",
]

# Monthly performance file columns, in file order.
MONTHLY_COLUMNS = [
    "loanSeqNumber", "mthlyRepPeriod", "currUPB", "currLoanDelinqStatus",
    "loanAge", "remainingMonthsLegMaturity", "repurchaseFlag",
    "modificationFlag", "zeroBalanceCode", "zeroBalanceEffectiveDate",
    "currInterestRate", "currDeferredUPB", "dueDateLastPaidInstallment",
    "mtgInsuranceRecovery", "netSalesProceeds", "nonMtgInsuranceRecovery",
    "expenses", "legalCosts", "maintenancePreservtnCosts",
    "taxesInsuranceOwed", "miscExpenses", "actualLossCalculation",
    "modificationCost", "Unknown",
]

# Typed columns after loading (A10 cast spec).
ORIGINATION_TYPES = {
    "creditScore": "int", "numberUnits": "int", "origCLTV": "double", "origDTI": "double",
    "origUPB": "double", "origLTV": "double", "origInterestRate": "double",
    "origLoanTerm": "int", "borrowers": "int",
}
MONTHLY_TYPES = {
    "currUPB": "double", "loanAge": "double", "remainingMonthsLegMaturity": "double",
    "currInterestRate": "double", "currDeferredUPB": "double",
}
ORIGINATION_DATES = {"firstPaymentDate": "yyyyMM", "maturityDate": "yyyyMM"}
MONTHLY_DATES = {"mthlyRepPeriod": "yyyyMM"}

# Bin map layout.
BIN_MAP_COLUMNS = ["loanSeqNumber", "binNumber", "binOccupancy", "maxBinOccupancy"]
MAX_BIN_OCCUPANCY = 10_000


def string_schema(columns) -> StructType:
    """All-string schema for reading a file layout before typing it."""
    return StructType([StructField(c, StringType(), True) for c in columns])
