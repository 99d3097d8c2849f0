"""Equity, capital structure and the weighted average cost of capital."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallybook.operators import formulas
from tallybook.plans import book_of, in_sections, over_all_years
from tallybook.sources import Ledger

Source = Ledger | DataFrame


def equity_by_year(source: Source) -> DataFrame:
    """Equity postings per year: ``year, total_equity``."""
    book = book_of(source, "equity").where("has_equity")
    return book.selectExpr("year", "equity as total_equity")


def equity_from_balance(source: Source) -> DataFrame:
    """Assets less liabilities per year: ``year, total_assets, total_liabilities, equity``."""
    book = book_of(source, "balance").where("has_balance")
    return book.selectExpr(
        "year",
        "assets as total_assets",
        "liabilities as total_liabilities",
        "assets - liabilities as equity",
    )


def capital_structure(source: Source) -> DataFrame:
    """Weights of equity and debt in firm value: ``year, equity_weight, debt_weight, firm_value``.

    The weights of a worthless firm are NULL.
    """
    sections = formulas.FIRM_VALUE_SECTIONS
    book = book_of(source, *sections).where(in_sections(*sections))
    return book.selectExpr(
        "year",
        f"{formulas.EQUITY_WEIGHT} as equity_weight",
        f"{formulas.DEBT_WEIGHT} as debt_weight",
        f"{formulas.FIRM_VALUE} as firm_value",
    )


def firm_value(source: Source) -> DataFrame:
    """Equity plus debt per year: ``year, firm_value``."""
    return capital_structure(source).select("year", "firm_value")


def equity_weight(source: Source) -> DataFrame:
    """Equity over firm value: ``year, equity_weight``."""
    return capital_structure(source).select("year", "equity_weight")


def debt_weight(source: Source) -> DataFrame:
    """Debt over firm value: ``year, debt_weight``."""
    return capital_structure(source).select("year", "debt_weight")


def wacc(
    source: Source, kind: str = "exact", cost_of_equity: float = formulas.COST_OF_EQUITY
) -> DataFrame:
    """Weighted average cost of capital: ``year, wacc``.

    ``kind`` is ``exact``, ``legacy`` (figures carried through text) or ``textbook`` (tax as a
    rate; the others use the tax gap).
    """
    book = book_of(source, *formulas.WACC_SECTIONS).where(formulas.has_wacc(kind))
    return book.selectExpr("year", f"{formulas.wacc(kind, cost_of_equity)} as wacc")


def with_interest_year_waccs(book: DataFrame, kind: str, cost_of_equity: float) -> DataFrame:
    """A book with ``waccs``: an ``interest_year, wacc`` for each interest year in the row of the
    first debt year, if that has the other figures that a WACC needs; NULL in all others."""
    sections = (s for s in formulas.WACC_SECTIONS if s != "interest")
    has_rest = in_sections(*sections)
    if kind != "textbook":
        has_rest += f" and {formulas.EBT} != 0"
    interest_year = "struct(year as interest_year, interest)"
    interest_years = over_all_years(f"collect_list(if(has_interest, {interest_year}, null))")
    first_debt = over_all_years("min(if(has_debt_paid, struct(year), null))")
    rate = formulas.wacc(kind, cost_of_equity, interest="i.interest")
    return book.selectExpr(
        "*", f"{interest_years} as interest_years", f"{first_debt} as first_debt"
    ).selectExpr(
        "*",
        f"if({has_rest} and year = first_debt.year, transform(interest_years, "
        f"i -> struct(i.interest_year as interest_year, {rate} as wacc)), null) as waccs",
    )


def wacc_by_interest_year(
    source: Source, kind: str = "exact", cost_of_equity: float = formulas.COST_OF_EQUITY
) -> DataFrame:
    """WACC with the cost of debt of ``cost_of_debt_by_interest_year``: ``year, interest_year, wacc``.

    That cost of debt has one row per interest year, all of the first debt year, which is the year
    its WACC is of. It has no row if that year lacks equity, debt by account, revenue or expense, or
    breaks even.
    """
    book = book_of(source, *formulas.WACC_SECTIONS)
    rated = with_interest_year_waccs(book, kind, cost_of_equity)
    return rated.selectExpr("year", "inline(waccs)")
