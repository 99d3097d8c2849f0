"""Every registered report against its SQL, on the order tables and on random ledgers."""

from __future__ import annotations

import math
import random
from datetime import date
from pathlib import Path

import __spark_entry__ as registry
import duckdb
import oracle
import pytest
from ledgers import CLASSES, SUB_TYPES, make_ledger, money, payment, posting

from tallybook import settle, year_book

TESTDATA = Path("/root/testdata/sf0.001")
WITHDRAWN = [f"withdrawn_{name}" for name in registry.WITHDRAWN]


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


def assert_same_rows(name, report, relation):
    columns = sorted(report.columns)
    assert sorted(relation.columns) == columns, name
    order = [relation.columns.index(c) for c in columns]

    def key(row):
        # Floats that differ in the last digit, or in the sign of 0, must not be sorted apart.
        return tuple((v is None, f"{v + 0.0:.8e}" if isinstance(v, float) else str(v)) for v in row)

    found = sorted((tuple(r[c] for c in columns) for r in report.collect()), key=key)
    expected = sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=key)
    assert len(found) == len(expected), name
    for got, want in zip(found, expected, strict=True):
        assert all(map(same, got, want)), (name, got, want)


def test_every_report_has_a_statement():
    assert set(registry.REPORTS) <= set(registry.oracle_sql())


@pytest.mark.skipif(not TESTDATA.exists(), reason="no order tables")
@pytest.mark.parametrize("name", [*registry.REPORTS, *WITHDRAWN])
def test_on_order_tables(spark, name):
    connection = duckdb.connect()
    for table in ("supplier", "orders", "lineitem"):
        connection.sql(f"create view {table} as from '{TESTDATA}/{table}.parquet'")
    report = registry.queries()[name](spark, str(TESTDATA))
    relation = connection.sql(registry.oracle_sql()[name])
    assert_same_rows(name, report, relation)
    kinds = {"INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string"}
    types = {c: kinds[str(t)] for c, t in zip(relation.columns, relation.types, strict=True)}
    assert types == dict(report.dtypes)


@pytest.mark.skipif(not TESTDATA.exists(), reason="no order tables")
def test_weights_of_a_withdrawn_ledger_survive_text(spark):
    queries, folder = registry.queries(), str(TESTDATA.with_name("sf0.01"))
    weights = queries["withdrawn_capital_structure"](spark, folder).collect()
    assert any(abs(r.equity_weight) > 1 and abs(r.debt_weight) > 1 for r in weights)
    rates = queries["withdrawn_legacy_wacc"](spark, folder).collect()
    assert any(r.wacc for r in rates)


@pytest.mark.skipif(not TESTDATA.exists(), reason="no order tables")
def test_entry(spark):
    assert registry.entry(spark).count() > 0


def random_rows(seed):
    """A ledger with gap years, NULLs, unknown and repeated keys, hot accounts and journals."""
    rng = random.Random(seed)
    years = rng.sample(range(2010, 2032), 9)

    def amount():
        return rng.choice([0, None, rng.randrange(10**6), rng.randrange(10**11) / 100])

    def year():
        return rng.choice([None, *years]) if rng.random() < 0.1 else rng.choice(years)

    chart = [
        (i, rng.choice(["Hutang", "Kas", "hutang", "HUTANG", "Utang"]) + f" {i % 50}", rng.choice([1, 2, 3, 4, 5]),
         None if rng.random() < 0.05 else date(rng.choice(years), 1, 1))
        for i in range(60)
    ]
    chart += [(3, "Hutang ganda", 4, date(years[0], 1, 1)), (0, "Tanpa kelas", None, None)]
    items = [
        posting(
            rng.choice([3, rng.randrange(65), None]) if rng.random() < 0.3 else rng.randrange(65),
            year(),
            amount(),
            amount(),
            rng.choice([1, rng.randrange(40)]),
            rng.choice([None, "Posting", "Pajak Bunga A", "pajak bunga", "PAJAK BUNGA"]),
        )
        for _ in range(1500)
    ]
    entries = [(j, date(rng.choice(years), 2, 2)) for j in range(35)]
    entries += [(1, None), (2, date(2011, 1, 1))]
    payments = [payment(rng.choice([3, rng.randrange(65)]), year(), amount()) for _ in range(500)]
    sub_types = rng.sample(SUB_TYPES, 6) + [("Equity", 3), ("Fixed Asset", 1), ("Current Asset", 9)]
    sub_types += [("equity", 3), ("FIXED ASSET", 1), ("current liability", 2)]
    return {
        "items": items,
        "entries": entries,
        "payments": payments,
        "chart": chart,
        "classes": [*CLASSES, (1,), (7,)],
        "sub_types": sub_types,
    }


def in_duckdb(rows):
    connection = duckdb.connect()

    def table(name, columns, values):
        connection.sql(f"create table {name} ({columns})")
        marks = ", ".join("?" * (columns.count(",") + 1 - columns.count("(15,2)")))
        connection.executemany(f"insert into {name} values ({marks})", values)

    def year(moment):
        return None if moment is None else moment.year

    table("account_class", "id int", rows["classes"])
    table("sub_type", "name varchar, class int", rows["sub_types"])
    table(
        "account",
        "id bigint, class int, name varchar, opened int",
        [(i, k, n, year(d)) for i, n, k, d in rows["chart"]],
    )
    table(
        "posting",
        "journal bigint, account_id bigint, y int, debit decimal(15,2), credit decimal(15,2), "
        "description varchar",
        [(j, a, year(t), money(d), money(c), s) for j, a, d, c, s, t in rows["items"]],
    )
    table(
        "payment",
        "account_id bigint, amount decimal(15,2), y int",
        [(a, money(m), year(d)) for a, m, d in rows["payments"]],
    )
    table("entry", "id bigint, y int", [(i, year(d)) for i, d in rows["entries"]])
    return connection


# How accounts are joined, and whether facts are reduced before that.
SHAPES = {
    "small chart": {"broadcast_bytes": 10**8},
    "large chart": {"broadcast_bytes": 0},
    "large facts": {"broadcast_bytes": 0, "filter_bytes": 0},
}


@pytest.mark.parametrize("match_case", [True, False], ids=["exact case", "any case"])
@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("seed", range(2))
def test_on_random_ledgers(spark, seed, shape, match_case):
    rows = random_rows(2 * seed + match_case)
    connection = in_duckdb(rows)
    ledger = make_ledger(spark, **rows, **SHAPES[shape], match_case=match_case)
    book = settle(year_book(ledger, names=True))
    for name, statement in oracle.oracle_sql(ledger="").items():
        if not match_case:
            statement = oracle.in_any_case(statement)
        source = ledger if name == "debt_single_account" else book
        report = registry._comparable(registry.REPORTS[name](source))
        assert_same_rows(name, report, connection.sql(statement))


@pytest.mark.parametrize("shape", SHAPES)
def test_roll_ups_of_some_classes_on_random_ledgers(spark, shape):
    """Reports that read a ledger, not a book of all sections, so that only some accounts are read."""
    rows = random_rows(11)
    connection = in_duckdb(rows)
    ledger = make_ledger(spark, **rows, **SHAPES[shape])
    for name in ("annual_revenue", "debt_by_payment_year", "equity_by_year", "wacc"):
        report = registry._comparable(registry.REPORTS[name](ledger))
        assert_same_rows(name, report, connection.sql(oracle.oracle_sql(ledger="")[name]))
