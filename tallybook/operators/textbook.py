"""Formulas stated alongside the valuation but not used in its report.

They discount by the textbook WACC (numeric weights, tax as a rate) and grow by the mean of the
yearly growth of net revenue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallybook.functions import power
from tallybook.operators import formulas
from tallybook.operators.capital import wacc
from tallybook.plans import book_of, in_sections, over_all_years
from tallybook.sources import Ledger

Source = Ledger | DataFrame

# Fixed value: the years of projected cash flow a fair value adds up.
FAIR_VALUE_YEARS = 3


def wacc_textbook(source: Source, cost_of_equity: float = formulas.COST_OF_EQUITY) -> DataFrame:
    """WACC with tax as a rate: ``year, wacc``."""
    return wacc(source, "textbook", cost_of_equity)


def _rated(source: Source, cost_of_equity: float) -> DataFrame:
    """The years with cash flow and WACC: ``year, free_cash_flow, wacc, mean_growth``."""
    sections = tuple(dict.fromkeys((*formulas.FCF_SECTIONS, *formulas.WACC_SECTIONS)))
    raw_growth = formulas.growth("revenue", formulas.previous("revenue"))
    mean_growth = over_all_years("avg(raw_growth)")
    return (
        book_of(source, *sections)
        .selectExpr("*", f"{raw_growth} as raw_growth")
        .selectExpr("*", f"{mean_growth} as mean_growth")
        .where(in_sections(*sections))
        .selectExpr(
            "year",
            f"cast({formulas.FREE_CASH_FLOW} as double) as free_cash_flow",
            f"{formulas.wacc('textbook', cost_of_equity)} as wacc",
            "mean_growth",
        )
    )


def pv_fcf_wacc(
    source: Source,
    base_year: int = formulas.BASE_YEAR,
    cost_of_equity: float = formulas.COST_OF_EQUITY,
) -> DataFrame:
    """Cash flow discounted by WACC: ``year, free_cash_flow, wacc, present_value_fcf``.

    A year ``t`` after the base year is discounted over ``t + 1`` periods.
    """
    present = formulas.present_value("free_cash_flow", "wacc", f"(year - {base_year} + 1)")
    return _rated(source, cost_of_equity).selectExpr(
        "year", "free_cash_flow", "wacc", f"{present} as present_value_fcf"
    )


def terminal_value_mean_g(
    source: Source, cost_of_equity: float = formulas.COST_OF_EQUITY
) -> DataFrame:
    """Gordon growth value by mean growth.

    ``year, free_cash_flow, mean_growth, wacc, terminal_value``.
    """
    terminal = formulas.gordon_terminal_value("free_cash_flow", "wacc", "mean_growth")
    return _rated(source, cost_of_equity).selectExpr(
        "year", "free_cash_flow", "mean_growth", "wacc", f"{terminal} as terminal_value"
    )


def fair_value(source: Source, cost_of_equity: float = formulas.COST_OF_EQUITY) -> DataFrame:
    """Fair value as of each year: ``year, present_value_fcf, present_value_terminal, fair_value``.

    The present values of the next three years' projected cash flow, and that of the terminal value
    after them.
    """

    def projected(years_ahead: int) -> str:
        return f"free_cash_flow * {power('1D + mean_growth', str(years_ahead))}"

    ahead = range(1, FAIR_VALUE_YEARS + 1)
    flows = (formulas.present_value(projected(k), "wacc", str(k)) for k in ahead)
    terminal = formulas.gordon_terminal_value(projected(FAIR_VALUE_YEARS), "wacc", "mean_growth")
    present_terminal = formulas.present_value(terminal, "wacc", str(FAIR_VALUE_YEARS))
    return _rated(source, cost_of_equity).selectExpr(
        "year",
        f"{' + '.join(flows)} as present_value_fcf",
        f"{present_terminal} as present_value_terminal",
        "present_value_fcf + present_value_terminal as fair_value",
    )
