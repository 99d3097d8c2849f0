"""The valuation formulas, as SQL expressions over a year book.

``carry`` says how a figure enters the next formula: ``exact`` keeps the number, ``through_text``
formats it and reads the text back, which is the legacy behaviour.
"""

from __future__ import annotations

from collections.abc import Callable

from tallybook.functions import decimal_3_1, divide, exact, power, through_text
from tallybook.plans import in_sections, over_previous_year

# Cost of equity, the year present values refer to, the projection horizon.
COST_OF_EQUITY = 3.938725
BASE_YEAR = 2023
HORIZON = 2028

Carry = Callable[[str], str]
MODES: dict[str, Carry] = {"exact": exact, "legacy": through_text}
WACC_KINDS = (*MODES, "textbook")

FCF_SECTIONS = ("income", "expense", "components")
EBT_SECTIONS = ("income", "expense")
FIRM_VALUE_SECTIONS = ("equity", "debt_opened")
COST_OF_DEBT_SECTIONS = ("debt_paid", "interest")
WACC_SECTIONS = (*EBT_SECTIONS, *FIRM_VALUE_SECTIONS, *COST_OF_DEBT_SECTIONS)

EBT = "(revenue - expense)"
FREE_CASH_FLOW = f"({EBT} + depreciation_amortization + change_in_working_capital - capex)"

FIRM_VALUE = "(equity + debt_opened)"
EQUITY_WEIGHT = divide("equity", FIRM_VALUE)
DEBT_WEIGHT = divide("debt_opened", FIRM_VALUE)

# Expense less EBT: an amount, used where a tax rate is expected.
TAX_GAP = f"(expense - {EBT})"
TAX_RATE_RATIO = divide("expense", EBT)


def cost_of_debt(carry: Carry = exact, interest: str = "interest") -> str:
    return divide(carry(interest), carry("debt_paid"))


def has_wacc(kind: str) -> str:
    """Whether a year has a WACC: all its inputs exist and, for a tax gap, EBT is not zero."""
    matched = in_sections(*WACC_SECTIONS)
    return matched if kind == "textbook" else f"{matched} and {EBT} != 0"


def wacc(kind: str, cost_of_equity: float, interest: str = "interest") -> str:
    """Weighted average cost of capital of a year, with the interest of that year or another.

    ``exact`` and ``legacy`` use the tax gap, ``textbook`` the tax rate.
    """
    if kind not in WACC_KINDS:
        raise ValueError(f"kind must be one of {WACC_KINDS}, not {kind!r}")
    carry = MODES.get(kind, exact)
    tax = TAX_RATE_RATIO if kind == "textbook" else carry(TAX_GAP)
    debt_part = f"{carry(DEBT_WEIGHT)} * {carry(cost_of_debt(carry, interest))}"
    return f"({carry(EQUITY_WEIGHT)} * {float(cost_of_equity)}D + {debt_part} * (1D - {tax}))"


def growth(current: str, previous: str) -> str:
    return divide(f"({current} - {previous})", previous)


def previous(figure: str) -> str:
    """A figure of the calendar year before."""
    return over_previous_year(f"sum({figure})")


def revenue_growth_1dp() -> str:
    """Growth of net revenue over the year before, as DECIMAL(3,1)."""
    return decimal_3_1(growth("revenue", previous("revenue")))


def present_value(amount: str, rate: str, periods: str) -> str:
    return divide(amount, power(f"1D + {rate}", periods))


def gordon_terminal_value(cash_flow: str, rate: str, rate_of_growth: str) -> str:
    return divide(f"({cash_flow} * (1D + {rate_of_growth}))", f"({rate} - {rate_of_growth})")
