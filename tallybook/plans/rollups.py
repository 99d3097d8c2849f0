"""Roll-ups of the fact tables to a few rows per year.

Each scans its fact once and sums on the map side, so a hot account or journal reaches the shuffle
as at most one row per task and key. What each key joins to afterwards is a rolled-up row.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.sums import as_money, in_limbs, summed
from tallybook.plans.filters import reduced
from tallybook.sources.ledger import Ledger

# The text that marks debt accounts and interest postings.
DEBT_ACCOUNT_TEXT = "Hutang"
INTEREST_POSTING_TEXT = "Pajak Bunga"


def posting_totals(
    ledger: Ledger, classes: Collection[int] | None = None, share: int = 1
) -> DataFrame:
    """One row per account class and year of posting: ``class, year, debit, credit, net_debit``.

    ``net_debit`` sums debit − credit posting by posting, so it skips a posting that lacks either
    side; the difference of the other two does not. Sums a report leaves unused are pruned.

    Accounts that fit a broadcast (a ``share``-th of its bytes) are joined first, which leaves a
    shuffle of one row per task, class and year. If there are more, they are joined after rolling up
    to account and year, and a large fact is first reduced to the accounts of ``classes``.
    """
    accounts = ledger.table("chart_of_accounts").selectExpr("id as account", "type as class")
    if classes is not None:
        accounts = accounts.where(f"class in ({', '.join(map(str, sorted(classes)))})")
    fits = ledger.fits_broadcast(accounts, share)
    items = ledger.table("journal_items")
    if classes is not None and not fits and ledger.is_large("journal_items"):
        items = reduced(items, "account", accounts, "account")
    figures, money = ("debit", "credit", "net_debit"), ledger.money("journal_items")
    postings = in_limbs(
        items,
        ["account", "year(created_at) as year"],
        money,
        {"debit": "debit", "credit": "credit"},
        {"net_debit": ("debit", "credit")},
    )
    if fits:
        classified = postings.join(F.broadcast(accounts), "account")
    else:
        by_account = summed(postings, ["account", "year"], money, figures)
        classified = by_account.join(accounts, "account")
    keys = ["class", "year"]
    return as_money(summed(classified, keys, money, figures), keys, money, figures)


def debt_payments(
    ledger: Ledger, account_id: int | None = None, names: bool = False, share: int = 1
) -> DataFrame:
    """Payments on debt accounts by ``paid_year`` and ``opened_year`` of the account: ``amount``.

    Debt accounts are those whose name marks them so or, if given, the one with ``account_id``.
    With ``names`` there is also ``account_name``, the first name in text order of the accounts paid
    on. Payments carry a number for it, not the name: accounts that fit a broadcast are ranked by
    name, and more are joined with their names after the payments are rolled up.
    """
    if account_id is None:
        is_debt = ledger.marked("name", DEBT_ACCOUNT_TEXT)
    else:
        is_debt = f"id = {int(account_id)}"
    accounts = ledger.table("chart_of_accounts").where(is_debt).selectExpr(
        "id as account_id",
        "year(created_at) as opened_year",
        *(["name as account_name"] if names else []),
    )
    fits = ledger.fits_broadcast(accounts, share)
    payments = ledger.table("invoice_payments")
    if not fits and ledger.is_large("invoice_payments"):
        payments = reduced(payments, "account_id", accounts, "account_id")
    money = ledger.money("invoice_payments")
    limbs = in_limbs(
        payments, ["account_id", "year(date) as paid_year"], money, {"amount": "amount"}
    )
    keys = ["paid_year", "opened_year"]
    if not fits:
        by_account = summed(limbs, ["account_id", "paid_year"], money, ["amount"])
        name = ["min(account_name) as account_name"] if names else []
        on_debt = summed(by_account.join(accounts, "account_id"), keys, money, ["amount"], *name)
    elif names:
        # The ranking has one task, for no more accounts than a broadcast holds.
        ranked = accounts.selectExpr("*", "dense_rank() over (order by account_name) as place")
        paid = limbs.join(F.broadcast(ranked.drop("account_name")), "account_id")
        sums = summed(paid, keys, money, ["amount"], "min(place) as place")
        named = ranked.select("place", "account_name").distinct()
        on_debt = sums.join(F.broadcast(named), "place")
    else:
        paid = limbs.join(F.broadcast(accounts), "account_id")
        on_debt = summed(paid, keys, money, ["amount"])
    return as_money(on_debt, keys + ["account_name"] * names, money, ["amount"])


def interest_totals(ledger: Ledger) -> DataFrame:
    """Interest postings by year of their journal entry: ``year, interest``.

    Postings are summed per journal before the join, so no journal is hot in it; the roll-up is
    already partitioned by journal, so only the entries' id and year are shuffled besides. Of large
    entries, those of journals without interest are left out before that.
    """
    is_interest = ledger.marked("description", INTEREST_POSTING_TEXT)
    postings = ledger.table("journal_items").where(f"{is_interest} and journal is not null")
    money, figures = ledger.money("journal_items"), ["interest"]
    limbs = in_limbs(postings, ["journal"], money, {"interest": "debit"})
    by_journal = summed(limbs, ["journal"], money, figures)
    entries = ledger.table("journal_entries")
    if ledger.is_large("journal_entries"):
        entries = reduced(entries, "id", with_interest(by_journal), "journal")
    entries = entries.selectExpr("id as journal", "year(date) as year")
    by_year = summed(by_journal.join(entries, "journal"), ["year"], money, figures)
    return as_money(by_year, ["year"], money, figures)


def with_interest(by_journal: DataFrame) -> DataFrame:
    """The journals with interest, for a filter.

    The condition holds for every row. It keeps the sums in the plan, which is then the roll-up that
    the report joins, so that the shuffle of one serves both and the postings are read once.
    """
    sums = [c for c in by_journal.columns if c.startswith("interest_")]
    return by_journal.where(f"interest_rows >= 0 or xxhash64({', '.join(sums)}) = 0")
