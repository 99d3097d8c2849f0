"""Free cash flow and its components."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallybook.operators import formulas
from tallybook.plans import book_of, in_sections, total
from tallybook.sources import Ledger

Source = Ledger | DataFrame


def fcf_components(source: Source) -> DataFrame:
    """``year, depreciation_amortization, change_in_working_capital, capex``."""
    book = book_of(source, "components").where("has_components")
    return book.select("year", "depreciation_amortization", "change_in_working_capital", "capex")


def fcf_pooled_ebt(source: Source) -> DataFrame:
    """Free cash flow per year with the EBT of all years together.

    ``year, total_revenue, total_expense, free_cash_flow``; revenue and expense are the same in
    every row.
    """
    book = book_of(source, *formulas.FCF_SECTIONS)
    sides = ("income_credit", "income_debit", "expense_debit", "expense_credit")
    credit, debit, spent, refunded = (total(book, side, over="over ()") for side in sides)
    book = book.selectExpr(
        "year",
        "has_components",
        f"{credit} - {debit} as revenue",
        f"{spent} - {refunded} as expense",
        "depreciation_amortization",
        "change_in_working_capital",
        "capex",
    )
    return book.where("has_components").selectExpr(
        "year",
        "revenue as total_revenue",
        "expense as total_expense",
        f"{formulas.FREE_CASH_FLOW} as free_cash_flow",
    )


def fcf_annual(source: Source) -> DataFrame:
    """Free cash flow per year that has revenue, expense and components.

    ``year, total_revenue, total_expense, ebt, free_cash_flow``.
    """
    sections = formulas.FCF_SECTIONS
    return _fcf_columns(book_of(source, *sections).where(in_sections(*sections)))


def fcf_annual_left(source: Source) -> DataFrame:
    """As ``fcf_annual``, keeping years that lack revenue or expense with NULL figures."""
    return _fcf_columns(fcf_rows(book_of(source, *formulas.FCF_SECTIONS)))


def fcf_rows(book: DataFrame) -> DataFrame:
    """The years with components; revenue and expense only where they join on a year."""
    return book.where("has_components").selectExpr(
        "* except (revenue, expense)",
        "if(year is null, null, revenue) as revenue",
        "if(year is null, null, expense) as expense",
    )


def _fcf_columns(book: DataFrame) -> DataFrame:
    return book.selectExpr(
        "year",
        "revenue as total_revenue",
        "expense as total_expense",
        f"{formulas.EBT} as ebt",
        f"{formulas.FREE_CASH_FLOW} as free_cash_flow",
    )
