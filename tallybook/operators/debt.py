"""Debt, interest and cost of debt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import divide, number_text
from tallybook.operators import formulas
from tallybook.plans import book_of, debt_payments, in_sections, over_all_years
from tallybook.sources import Ledger

Source = Ledger | DataFrame


def _debt(source: Source, section: str) -> DataFrame:
    book = book_of(source, section, names=True).where(f"has_{section}")
    return book.selectExpr(
        "year", f"{section}_name as account_name", f"{section} as total_debt"
    )


def debt_by_payment_year(source: Source) -> DataFrame:
    """Payments on debt accounts by year of payment: ``year, account_name, total_debt``.

    The account name is the first in text order; a book given as source needs ``names``.
    """
    return _debt(source, "debt_paid")


def debt_by_account_year(source: Source) -> DataFrame:
    """Payments on debt accounts by year the account was opened, as ``debt_by_payment_year``."""
    return _debt(source, "debt_opened")


def debt_single_account(ledger: Ledger, account_id: int) -> DataFrame:
    """Payments on one account by year of payment: ``year, account_name, total_debt``."""
    payments = debt_payments(ledger, account_id=account_id, names=True)
    return (
        payments.selectExpr("paid_year as year", "account_name", "amount")
        .groupBy("year")
        .agg(F.expr("min(account_name) as account_name"), F.expr("sum(amount) as total_debt"))
    )


def interest_by_entry_year(source: Source) -> DataFrame:
    """Interest postings by year of their journal entry: ``year, total_interest``."""
    book = book_of(source, "interest").where("has_interest")
    return book.selectExpr("year", "interest as total_interest")


def debt_interest_matrix(source: Source) -> DataFrame:
    """Each year's debt next to each year's interest.

    ``debt_year, account_name, total_debt, interest_year, total_interest``. The result itself is
    years × years; both sides are read off the year book, so its size does not depend on the ledger.
    """
    interest_year = "struct(year as interest_year, interest as total_interest)"
    interest_years = over_all_years(f"collect_list(if(has_interest, {interest_year}, null))")
    book = book_of(source, "debt_paid", "interest", names=True)
    return (
        book.selectExpr("*", f"{interest_years} as interest_years")
        .where("has_debt_paid")
        .selectExpr(
            "year as debt_year",
            "debt_paid_name as account_name",
            "debt_paid as total_debt",
            "inline(interest_years)",
        )
    )


def _cost_of_debt(pairs: DataFrame, mode: str) -> DataFrame:
    carry = formulas.MODES[mode]
    show = number_text if mode == "legacy" else str
    ratio = divide(carry("total_interest"), carry("total_debt"))
    return pairs.selectExpr(
        "debt_year",
        "interest_year",
        f"{show('total_debt')} as total_debt",
        f"{show('total_interest')} as total_interest",
        f"{show(ratio)} as cost_of_debt",
    )


def cost_of_debt_cross(source: Source, mode: str = "exact") -> DataFrame:
    """Interest over debt for each pair of a debt year and an interest year.

    ``debt_year, interest_year, total_debt, total_interest, cost_of_debt``. In ``legacy`` mode the
    figures are id_ID text, and the ratio is taken from that text.
    """
    return _cost_of_debt(debt_interest_matrix(source), mode)


def cost_of_debt_by_interest_year(source: Source, mode: str = "exact") -> DataFrame:
    """``cost_of_debt_cross`` with one row per interest year, that of the first debt year."""
    pairs = cost_of_debt_cross(source, mode)
    rest = [column for column in pairs.columns if column != "interest_year"]
    first = pairs.groupBy("interest_year").agg(F.min(F.struct(*rest)).alias("first"))
    return first.selectExpr("interest_year", "first.*").select(*pairs.columns)


def cost_of_debt(source: Source, mode: str = "exact") -> DataFrame:
    """Interest over debt of the same year, columns and modes as ``cost_of_debt_cross``."""
    sections = formulas.COST_OF_DEBT_SECTIONS
    pairs = (
        book_of(source, *sections)
        .where(in_sections(*sections))
        .selectExpr(
            "year as debt_year",
            "year as interest_year",
            "debt_paid as total_debt",
            "interest as total_interest",
        )
    )
    return _cost_of_debt(pairs, mode)
