"""Revenue, expense, earnings before tax and tax figures."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallybook.operators import formulas
from tallybook.plans import book_of, in_sections, total
from tallybook.sources import Ledger

Source = Ledger | DataFrame


def total_revenue(source: Source) -> DataFrame:
    """Net revenue over all years, one row: ``total_revenue``."""
    book = book_of(source, "income")
    credit, debit = total(book, "income_credit"), total(book, "income_debit")
    return book.selectExpr(f"{credit} - {debit} as total_revenue")


def total_expense(source: Source) -> DataFrame:
    """Expense over all years, one row: ``total_expense``."""
    book = book_of(source, "expense")
    debit, credit = total(book, "expense_debit"), total(book, "expense_credit")
    return book.selectExpr(f"{debit} - {credit} as total_expense")


def annual_revenue(source: Source) -> DataFrame:
    """Net revenue per year: ``year, total_revenue``."""
    book = book_of(source, "income").where("has_income")
    return book.selectExpr("year", "revenue as total_revenue")


def annual_gross_revenue(source: Source) -> DataFrame:
    """Debits on revenue accounts per year: ``year, total_revenue``."""
    book = book_of(source, "gross_income").where("has_gross_income")
    return book.selectExpr("year", "gross_revenue as total_revenue")


def annual_expense(source: Source) -> DataFrame:
    """Expense per year: ``year, total_expense``."""
    book = book_of(source, "expense").where("has_expense")
    return book.selectExpr("year", "expense as total_expense")


def _with_ebt(source: Source) -> DataFrame:
    return book_of(source, *formulas.EBT_SECTIONS).where(in_sections(*formulas.EBT_SECTIONS))


def ebt(source: Source) -> DataFrame:
    """Earnings before tax per year with both revenue and expense: ``year, ebt``."""
    return _with_ebt(source).selectExpr("year", f"{formulas.EBT} as ebt")


def tax_gap(source: Source) -> DataFrame:
    """Expense less EBT per year with a non-zero EBT: ``year, tax_gap``."""
    taxed = _with_ebt(source).where(f"{formulas.EBT} != 0")
    return taxed.selectExpr("year", f"{formulas.TAX_GAP} as tax_gap")


def tax_rate_ratio(source: Source) -> DataFrame:
    """Expense over EBT per year, NULL for a zero EBT: ``year, tax_rate``."""
    return _with_ebt(source).selectExpr("year", f"{formulas.TAX_RATE_RATIO} as tax_rate")
