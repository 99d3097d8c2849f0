"""Small ledgers written by hand or at random."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from tallybook import Ledger
from tallybook.sources.ledger import TABLE_COLUMNS

CLASSES = [(c,) for c in (1, 2, 3, 4, 5)]
SUB_TYPES = [
    ("Current Asset", 1),
    ("Fixed Asset", 1),
    ("Current Liability", 2),
    ("Long Term Liability", 2),
    ("Equity", 3),
    ("Income", 4),
    ("Expense", 5),
]
# One account per class: id, name, class, year opened.
CHART = [
    (1, "Kas", 1, date(2020, 1, 1)),
    (2, "Hutang Bank", 2, date(2021, 1, 1)),
    (3, "Modal", 3, date(2020, 1, 1)),
    (4, "Penjualan", 4, date(2020, 1, 1)),
    (5, "Beban", 5, date(2020, 1, 1)),
]


def money(amount) -> Decimal | None:
    return None if amount is None else Decimal(str(amount)).quantize(Decimal("0.01"))


def posting(account, year, debit=0, credit=0, journal=1, description="Posting"):
    """A journal item; ``year`` is the year of its own clock, created_at."""
    created = None if year is None else datetime(year, 6, 15)
    return (journal, account, money(debit), money(credit), description, created)


def payment(account, year, amount):
    return (account, money(amount), None if year is None else date(year, 6, 15))


def make_ledger(
    spark: SparkSession,
    items=(),
    entries=(),
    payments=(),
    chart=CHART,
    classes=CLASSES,
    sub_types=SUB_TYPES,
    **options,
) -> Ledger:
    rows = {
        "journal_items": items,
        "journal_entries": entries,
        "invoice_payments": payments,
        "chart_of_accounts": chart,
        "chart_of_account_types": classes,
        "chart_of_account_sub_types": sub_types,
    }
    frames = {
        table: spark.createDataFrame(list(rows[table]), ", ".join(map(" ".join, columns.items())))
        for table, columns in TABLE_COLUMNS.items()
    }
    return Ledger.from_frames(frames, **options)


def by_year(report: DataFrame) -> dict:
    """The rows of a report by year, without the year."""
    return {row[0]: tuple(row)[1:] for row in report.collect()}
