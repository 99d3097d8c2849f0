"""Sums of money of any type against Python's integers, in both ANSI modes, and sums out of range."""

from __future__ import annotations

import random
from collections import defaultdict
from contextlib import contextmanager
from datetime import datetime
from decimal import Decimal, localcontext

import pytest
from ledgers import CHART, CLASSES, SUB_TYPES
from pyspark.errors import PySparkException

from tallybook import Ledger
from tallybook import operators as ops
from tallybook.functions.sums import Money, as_money, in_limbs, summed
from tallybook.plans import debt_payments, interest_totals, posting_totals

TYPES = [
    ("decimal(15,2)", "decimal(15,2)"),
    ("decimal(15,6)", "decimal(9,0)"),
    ("decimal(18,4)", "decimal(18,4)"),
    ("decimal(20,2)", "int"),
    ("decimal(38,2)", "decimal(38,2)"),
    ("decimal(38,10)", "decimal(12,2)"),
    ("decimal(38,18)", "bigint"),
    ("bigint", "smallint"),
]
types = pytest.mark.parametrize("debit, credit", TYPES, ids=["/".join(t) for t in TYPES])
WHOLE = {"int": 9, "bigint": 18, "smallint": 4}


@pytest.fixture(params=["true", "false"], ids=["ansi", "not ansi"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


@contextmanager
def exactly():
    with localcontext() as context:
        context.prec = 90
        yield


def digits_of(kind):
    if kind in WHOLE:
        return WHOLE[kind], 0
    precision, scale = map(int, kind[8:-1].split(","))
    return precision - scale, scale


def amounts(rng, kind, count):
    """Amounts of every length, some of them the longest there are, leaving a digit for the sums."""
    whole, scale = digits_of(kind)
    most = 10 ** (whole + scale - (2 if whole + scale > 36 else 0)) - 1
    with exactly():
        for _ in range(count):
            units = rng.choice((most, -most, 0, 1, -1, rng.randrange(10 ** rng.randrange(1, 39)) % most))
            yield None if rng.random() < 0.1 else Decimal(units).scaleb(-scale)


def ledger_of(spark, postings, debit, credit, payments=(), amount="decimal(15,2)", **options):
    """A ledger whose amounts have the given types; postings are (class, year, debit, credit)."""
    rows = [
        (year, klass, None if d is None else f"{d:f}", None if c is None else f"{c:f}",
         "Pajak Bunga", datetime(year, 1, 1))
        for klass, year, d, c in postings
    ]
    text = "journal bigint, account bigint, debit string, credit string, description string, "
    frames = {
        "journal_items": spark.createDataFrame(rows, text + "created_at timestamp_ntz").selectExpr(
            "journal", "account", f"cast(debit as {debit}) as debit",
            f"cast(credit as {credit}) as credit", "description", "created_at",
        ),
        "journal_entries": spark.sql("select id, make_date(cast(id as int), 1, 1) as date "
                                     "from range(1990, 2040)"),
        "invoice_payments": spark.createDataFrame(
            [(2, f"{a:f}", datetime(2023, 1, 1)) for a in payments],
            "account_id bigint, amount string, date date",
        ).selectExpr("account_id", f"cast(amount as {amount}) as amount", "date"),
        "chart_of_accounts": spark.createDataFrame(
            CHART, "id bigint, name string, type int, created_at date"
        ),
        "chart_of_account_types": spark.createDataFrame(CLASSES, "id int"),
        "chart_of_account_sub_types": spark.createDataFrame(SUB_TYPES, "name string, type int"),
    }
    return Ledger.from_frames(frames, **options)


@types
@pytest.mark.parametrize("broadcast_bytes", [10**9, 0], ids=["small chart", "large chart"])
def test_totals_are_exact(spark, ansi, debit, credit, broadcast_bytes):
    rng = random.Random(debit + credit)
    postings = [
        (rng.randrange(1, 6), rng.choice((2021, 2022)), d, c)
        for d, c in zip(amounts(rng, debit, 400), amounts(rng, credit, 400), strict=True)
    ]
    expected = defaultdict(lambda: [None, None, None])
    with exactly():
        for klass, year, d, c in postings:
            own = expected[klass, year]
            net = None if d is None or c is None else d - c
            for i, value in enumerate((d, c, net)):
                if value is not None:
                    own[i] = (own[i] or Decimal(0)) + value
    ledger = ledger_of(spark, postings, debit, credit, broadcast_bytes=broadcast_bytes)
    totals = posting_totals(ledger)
    scale = max(digits_of(debit)[1], digits_of(credit)[1])
    assert {t for c, t in totals.dtypes if c not in ("class", "year")} == {f"decimal(38,{scale})"}
    found = {(r["class"], r.year): [r.debit, r.credit, r.net_debit] for r in totals.collect()}
    assert found == dict(expected)
    interest = {r.year: r.interest for r in interest_totals(ledger).collect()}
    for year in (2021, 2022):
        with exactly():
            assert interest[year] == sum(d for _, y, d, _ in postings if y == year and d is not None)


@pytest.mark.parametrize("kind", ["decimal(18,4)", "decimal(30,10)", "decimal(38,2)"])
def test_reports_carry_the_scale(spark, ansi, kind):
    whole, scale = digits_of(kind)
    most = Decimal(10 ** (min(whole + scale, 31) - 1) - 1).scaleb(-scale)
    one = Decimal(1).scaleb(-scale)
    postings = [(4, 2022, one, most), (4, 2023, Decimal(0), one), (5, 2022, most - 3 * one, one),
                (5, 2023, one, Decimal(0)), (1, 2022, 7 * one, one), (3, 2022, one, 9 * one)]
    ledger = ledger_of(spark, postings, kind, kind, payments=[one * 5], amount=kind)
    found = {r.year: r for r in ops.fcf_annual(ledger).collect()}
    assert found[2022].total_revenue == most - one
    assert found[2022].total_expense == most - 4 * one
    assert found[2022].ebt == 3 * one
    # Assets count once per sub-type: depreciation is twice what working capital and capex are.
    (components,) = (r for r in ops.fcf_components(ledger).collect() if r.year == 2022)
    assert components.depreciation_amortization == 12 * one
    assert components.change_in_working_capital == components.capex == 6 * one
    (equity,) = ops.equity_by_year(ledger).collect()
    assert equity.total_equity == 8 * one
    assert ops.total_revenue(ledger).first().total_revenue == most
    (debt,) = ops.debt_by_payment_year(ledger).collect()
    assert debt.total_debt == 5 * one


def test_sums_out_of_range_fail_in_either_mode(spark, ansi):
    most = Decimal("9" * 36 + ".99")
    postings = [(4, 2022, Decimal(0), most)] * 2
    ledger = ledger_of(spark, postings, "decimal(38,2)", "decimal(38,2)")
    with pytest.raises(PySparkException):
        posting_totals(ledger).collect()
    # A total that fits, but leaves a book no digit to add with.
    whole = ledger_of(spark, postings[:1], "decimal(38,2)", "decimal(38,2)")
    assert posting_totals(whole).first().credit == most
    with pytest.raises(PySparkException):
        ops.annual_revenue(whole).collect()


def test_sums_of_limbs_out_of_range_fail_in_either_mode(spark, ansi):
    money = Money()
    limbs = spark.createDataFrame(
        [(1, 0, 2**62, 1), (1, 0, 2**62, 1), (2, 5, None, 0)],
        "k int, a_0 bigint, a_1 bigint, a_rows bigint",
    )
    assert summed(limbs.where("k = 2"), ["k"], money, ["a"]).first().a_1 is None
    with pytest.raises(PySparkException, match="sum of a is out of range"):
        summed(limbs, ["k"], money, ["a"]).collect()


def test_nothing_to_sum_is_null_and_zeros_are_zero(spark, ansi):
    money = Money(30, 8)
    rows = spark.sql("select * from values (1, null), (2, 0), (2, null) as t(k, a)")
    rows = rows.selectExpr("k", "cast(a as decimal(38,8)) as a")
    limbs = in_limbs(rows, ["k"], money, {"a": "a"})
    totals = as_money(summed(limbs, ["k"], money, ["a"]), ["k"], money, ["a"])
    assert sorted(map(tuple, totals.collect())) == [(1, None), (2, Decimal(0))]


@pytest.mark.parametrize("short", [Money(13, 2), Money(0, 15), Money(15, 0)])
def test_short_amounts_keep_every_unit(spark, short):
    rng = random.Random(3)
    units = [rng.randrange(-(10**15) + 1, 10**15) for _ in range(2_000)] + [10**15 - 1, 1, -1]
    rows = spark.createDataFrame([(1, f"{u}E-{short.scale}") for u in units], "k int, t string")
    kind = f"decimal({short.whole + short.scale},{short.scale})"
    limbs = in_limbs(rows.selectExpr("k", f"cast(t as {kind}) as a"), ["k"], short, {"a": "a"})
    (total,) = as_money(summed(limbs, ["k"], short, ["a"]), ["k"], short, ["a"]).collect()
    with exactly():
        assert total.a == Decimal(sum(units)).scaleb(-short.scale)


def test_types_that_are_not_exact_are_refused(spark):
    for kind in ("double", "float", "string", "boolean"):
        items = spark.range(1).selectExpr(
            "id as journal", "id as account", f"cast(1 as {kind}) as debit", "1 as credit",
            "'' as description", "timestamp_ntz'2021-01-01' as created_at",
        )
        with pytest.raises(ValueError, match=f"journal_items.debit is {kind}"):
            Ledger.from_frames({"journal_items": items}).table("journal_items")
    assert debt_payments(ledger_of(spark, [], "int", "int")).collect() == []
