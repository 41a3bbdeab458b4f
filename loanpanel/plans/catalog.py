"""All registered queries (importing a plan module registers its queries)."""

from __future__ import annotations

from loanpanel.plans import q_clean, q_files, q_lender, q_model, q_origination, q_panel, q_series  # noqa: F401
from loanpanel.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
