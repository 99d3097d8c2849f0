"""Roll-ups: exact sums, both join shapes, NULLs, repeated keys and hot keys."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from ledgers import CHART, make_ledger, money, payment, posting

from tallybook.plans import debt_payments, interest_totals, posting_totals

SHAPES = {"broadcast first": {}, "rolled up first": {"broadcast_bytes": 0}}
shapes = pytest.mark.parametrize("options", SHAPES.values(), ids=SHAPES.keys())


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_accounts_are_measured_with_their_texts(spark):
    chart = [(i, "x" * 1000, i % 5 + 1, None) for i in range(10)]

    def fits(limit, condition="true", columns=("id", "name")):
        ledger = make_ledger(spark, chart=chart, broadcast_bytes=limit)
        accounts = ledger.table("chart_of_accounts").where(condition)
        return ledger.fits_broadcast(accounts.select(*columns))

    assert fits(20_000)
    assert not fits(10_000)
    assert fits(10_000, condition="type = 1")
    assert fits(10_000, columns=["id"])
    assert fits(0, condition="false") and not fits(0)


@shapes
def test_posting_totals_are_exact_for_extreme_amounts(spark, options):
    largest = Decimal("9999999999999.99")
    amounts = [largest] * 500 + [Decimal("0.01")] * 3
    amounts += [-largest, Decimal("-0.01"), Decimal("1.15")]
    items = [posting(1, 2023, debit=a, credit=-a) for a in amounts]
    total = sum(amounts)
    (row,) = rows(posting_totals(make_ledger(spark, items, **options)))
    assert row == (1, 2023, total, -total, 2 * total)


@shapes
def test_posting_totals_skip_nulls_as_sums_do(spark, options):
    items = [
        posting(1, 2023, debit=10, credit=None),
        posting(1, 2023, debit=5, credit=2),
        posting(2, 2023, debit=None, credit=None),
        posting(None, 2023, debit=7, credit=7),
        posting(1, None, debit=1, credit=1),
    ]
    totals = rows(posting_totals(make_ledger(spark, items, **options)))
    assert totals == rows_of(
        (1, 2023, 15, 2, 3), (2, 2023, None, None, None), (1, None, 1, 1, 0)
    )


def rows_of(*expected):
    def typed(row):
        return (*row[:2], *map(money, row[2:]))

    return sorted((typed(r) for r in expected), key=repr)


@shapes
def test_repeated_accounts_repeat_their_postings(spark, options):
    chart = [*CHART, (1, "Kas lagi", 1, None), (1, "Kas sebagai beban", 5, None)]
    ledger = make_ledger(spark, [posting(1, 2023, debit=10)], chart=chart, **options)
    totals = rows(posting_totals(ledger))
    assert totals == rows_of((1, 2023, 20, 0, 20), (5, 2023, 10, 0, 10))


@shapes
def test_posting_totals_with_a_hot_account_match_brute_force(spark, options):
    rng = random.Random(7)
    chart = [(i, f"Akun {i}", i % 5 + 1, None) for i in range(200)]
    items, expected = [], defaultdict(lambda: [Decimal(0), Decimal(0), Decimal(0)])
    for _ in range(5000):
        account = 3 if rng.random() < 0.4 else rng.randrange(220)  # some are not in the chart
        year = rng.randrange(2019, 2024)
        debit, credit = (Decimal(rng.randrange(10**9)) / 100 for _ in range(2))
        items.append(posting(account, year, debit, credit))
        if account < 200 and account % 5 + 1 in (4, 5):
            for i, v in enumerate((debit, credit, debit - credit)):
                expected[account % 5 + 1, year][i] += v
    ledger = make_ledger(spark, items, chart=chart, **options)
    assert rows(posting_totals(ledger, classes=(4, 5))) == rows_of(
        *((*key, *values) for key, values in expected.items())
    )


@shapes
@pytest.mark.parametrize("names", [False, True])
def test_debt_payments(spark, options, names):
    chart = [*CHART, (6, "Hutang Usaha", 2, None), (7, "hutang kecil", 2, None)]
    payments = [
        payment(2, 2023, 100),
        payment(2, 2023, 50),
        payment(2, None, 1),
        payment(6, 2023, 7),
        payment(7, 2023, 900),  # the marker is case-sensitive
        payment(1, 2023, 900),
        payment(2, 2022, None),
    ]
    ledger = make_ledger(spark, payments=payments, chart=chart, **options)
    found = {tuple(r)[:-1]: r.amount for r in debt_payments(ledger, names=names).collect()}
    bank, trade = (("Hutang Bank",), ("Hutang Usaha",)) if names else ((), ())
    assert found == {
        (2023, 2021, *bank): Decimal("150.00"),
        (None, 2021, *bank): Decimal("1.00"),
        (2022, 2021, *bank): None,
        (2023, None, *trade): Decimal("7.00"),
    }


@shapes
def test_interest_follows_the_entry_date_and_survives_a_hot_journal(spark, options):
    interest = "Bayar Pajak Bunga Maret"
    items = [posting(5, 2020, debit=1, journal=1, description=interest) for _ in range(1000)]
    items += [
        posting(5, 2020, debit=5, journal=2, description=interest),
        posting(5, 2020, debit=5, journal=2, description="pajak bunga"),
        posting(5, 2020, debit=5, journal=9, description=interest),  # no such entry
        posting(5, 2020, debit=None, journal=3, description=interest),
        posting(5, 2020, debit=5, journal=1, description=None),
    ]
    # The year of an entry is the third column of a payment, too.
    dated = ((1, 2021), (2, 2022), (2, 2022), (3, 2024), (4, 2025))
    entries = [(journal, payment(0, year, 0)[2]) for journal, year in dated]
    ledger = make_ledger(spark, items, entries, **options)
    assert {r.year: r.interest for r in interest_totals(ledger).collect()} == {
        2021: Decimal("1000.00"),
        2022: Decimal("10.00"),
        2024: None,
    }
