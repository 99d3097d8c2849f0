"""How the ledger is reduced: facts are rolled up once, then every report reads the year book."""

from tallybook.plans.rollups import debt_payments, interest_totals, posting_totals
from tallybook.plans.yearbook import (
    SECTIONS,
    book_of,
    in_sections,
    over_all_years,
    over_previous_year,
    settle,
    total,
    year_book,
)

__all__ = [
    "SECTIONS",
    "book_of",
    "debt_payments",
    "in_sections",
    "interest_totals",
    "over_all_years",
    "over_previous_year",
    "posting_totals",
    "settle",
    "total",
    "year_book",
]
