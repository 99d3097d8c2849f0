"""The reports. Each takes a ``Ledger`` or a year book and returns one DataFrame."""

from tallybook.operators.capital import (
    capital_structure,
    debt_weight,
    equity_by_year,
    equity_from_balance,
    equity_weight,
    firm_value,
    wacc,
    wacc_by_interest_year,
)
from tallybook.operators.cash_flow import (
    fcf_annual,
    fcf_annual_left,
    fcf_components,
    fcf_pooled_ebt,
)
from tallybook.operators.debt import (
    cost_of_debt,
    cost_of_debt_by_interest_year,
    cost_of_debt_cross,
    debt_by_account_year,
    debt_by_payment_year,
    debt_interest_matrix,
    debt_single_account,
    interest_by_entry_year,
)
from tallybook.operators.growth import (
    annual_growth_1dp,
    mean_growth_1dp,
    mean_growth_inner,
    mean_growth_left,
    net_revenue_growth,
    revenue_growth,
)
from tallybook.operators.income import (
    annual_expense,
    annual_gross_revenue,
    annual_revenue,
    ebt,
    tax_gap,
    tax_rate_ratio,
    total_expense,
    total_revenue,
)
from tallybook.operators.presentation import fcf_annual_text, fcf_pooled_text, formatted
from tallybook.operators.textbook import (
    fair_value,
    pv_fcf_wacc,
    terminal_value_mean_g,
    wacc_textbook,
)
from tallybook.operators.valuation import (
    fcf_projection,
    fcf_projection_draft,
    pv_fcf,
    pv_terminal_value,
    terminal_value,
    valuation_draft,
    valuation_report,
)

__all__ = [
    "annual_expense",
    "annual_gross_revenue",
    "annual_growth_1dp",
    "annual_revenue",
    "capital_structure",
    "cost_of_debt",
    "cost_of_debt_by_interest_year",
    "cost_of_debt_cross",
    "debt_by_account_year",
    "debt_by_payment_year",
    "debt_interest_matrix",
    "debt_single_account",
    "debt_weight",
    "ebt",
    "equity_by_year",
    "equity_from_balance",
    "equity_weight",
    "fair_value",
    "fcf_annual",
    "fcf_annual_left",
    "fcf_annual_text",
    "fcf_components",
    "fcf_pooled_ebt",
    "fcf_pooled_text",
    "fcf_projection",
    "fcf_projection_draft",
    "firm_value",
    "formatted",
    "interest_by_entry_year",
    "mean_growth_1dp",
    "mean_growth_inner",
    "mean_growth_left",
    "net_revenue_growth",
    "pv_fcf",
    "pv_fcf_wacc",
    "pv_terminal_value",
    "revenue_growth",
    "tax_gap",
    "tax_rate_ratio",
    "terminal_value",
    "terminal_value_mean_g",
    "total_expense",
    "total_revenue",
    "valuation_draft",
    "valuation_report",
    "wacc",
    "wacc_by_interest_year",
    "wacc_textbook",
]
