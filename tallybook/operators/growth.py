"""Growth of revenue from year to year."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallybook.functions import decimal_3_1, number_text
from tallybook.operators import formulas
from tallybook.plans import book_of
from tallybook.sources import Ledger

Source = Ledger | DataFrame


def _growth(source: Source, section: str, figure: str) -> DataFrame:
    book = book_of(source, section).where(f"has_{section}")
    before = book.selectExpr(
        "year",
        f"{figure} as total_revenue",
        f"{formulas.previous(figure)} as previous_revenue",
    )
    return before.selectExpr(
        "*", f"{formulas.growth('total_revenue', 'previous_revenue')} as growth"
    )


def revenue_growth(source: Source) -> DataFrame:
    """Growth of gross revenue: ``year, total_revenue, previous_revenue, growth``.

    NULL for the first year, after a gap year, and over a year without revenue.
    """
    return _growth(source, "gross_income", "gross_revenue")


def net_revenue_growth(source: Source) -> DataFrame:
    """Growth of net revenue, as ``revenue_growth``."""
    return _growth(source, "income", "revenue")


# The year and revenue shown beside an all-years mean are those of the last year.
_LAST_REVENUE = "max_by(total_revenue, year)"


def mean_growth_left(source: Source) -> DataFrame:
    """Mean growth of gross revenue as id_ID text, one row: ``year, revenue, mean_growth``."""
    return revenue_growth(source).selectExpr(
        "max(year) as year",
        f"{_LAST_REVENUE} as revenue",
        f"{number_text('avg(growth)')} as mean_growth",
    )


def mean_growth_inner(source: Source) -> DataFrame:
    """Mean growth of gross revenue, one row: ``year, revenue, mean_growth``."""
    return revenue_growth(source).selectExpr(
        "max(year) as year", f"{_LAST_REVENUE} as revenue", "avg(growth) as mean_growth"
    )


def mean_growth_1dp(source: Source) -> DataFrame:
    """Mean growth of net revenue as DECIMAL(3,1), one row: ``year, revenue, mean_growth``."""
    return net_revenue_growth(source).selectExpr(
        "max(year) as year",
        f"{number_text(_LAST_REVENUE)} as revenue",
        f"{decimal_3_1('avg(growth)')} as mean_growth",
    )


def annual_growth_1dp(source: Source) -> DataFrame:
    """Growth of net revenue per year as DECIMAL(3,1): ``year, revenue, growth``."""
    rates = net_revenue_growth(source).where("year is not null")
    return rates.selectExpr(
        "year", "total_revenue as revenue", f"{decimal_3_1('growth')} as growth"
    )
