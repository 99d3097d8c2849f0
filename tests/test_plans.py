"""Plan shapes that decide whether a report survives a large ledger."""

from __future__ import annotations

import io
import re
import time
from collections import Counter
from contextlib import contextmanager, redirect_stdout
from pathlib import Path

import __spark_entry__ as registry
import pytest
from ledgers import CHART, CLASSES, SUB_TYPES, make_ledger, payment, posting

from pyspark.sql import functions as F

from tallybook import Ledger, ledger_from_orders
from tallybook import operators as ops
from tallybook.plans import debt_payments, posting_totals
from tallybook.plans.filters import reduced
from tallybook.sources.ledger import TABLE_COLUMNS, estimated_bytes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    target = tmp_path_factory.mktemp("ledger")
    ledger = make_ledger(
        spark,
        items=[posting(4, 2022, credit=5), posting(5, 2022, debit=3, description="Pajak Bunga")],
        entries=[(1, payment(1, 2022, 1)[2])],
        payments=[payment(2, 2022, 4)],
        chart=CHART,
        classes=CLASSES,
        sub_types=SUB_TYPES,
    )
    for table in TABLE_COLUMNS:
        ledger.table(table).write.parquet(str(target / f"{table}.parquet"))
    return str(target)


def plan_of(report, mode="simple"):
    text = io.StringIO()
    with redirect_stdout(text):
        report.explain(mode)
    return text.getvalue()


def scans(plan):
    return Counter(re.findall(r"/(\w+)\.parquet\]", plan))


@pytest.mark.parametrize("broadcast_bytes", [10**9, 0], ids=["small chart", "large chart"])
def test_a_valuation_reads_each_fact_once_per_roll_up(spark, folder, broadcast_bytes):
    ledger = Ledger.from_parquet(spark, folder, broadcast_bytes=broadcast_bytes)
    found = scans(plan_of(ops.valuation_report(ledger)))
    assert found == {
        "journal_items": 2,  # by account, and by journal for interest
        "journal_entries": 1,
        "invoice_payments": 1,
        "chart_of_accounts": 2,
        "chart_of_account_types": 1,
        "chart_of_account_sub_types": 1,
    }


REPORTS = {
    "valuation": ops.valuation_report,
    "legacy valuation": lambda led: ops.valuation_report(led, mode="legacy"),
    "matrix": ops.debt_interest_matrix,
    "pooled": ops.fcf_pooled_ebt,
    "draft": ops.fcf_projection_draft,
    "fair value": ops.fair_value,
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports_have_no_cross_join_and_no_python(spark, folder, name):
    plan = plan_of(REPORTS[name](Ledger.from_parquet(spark, folder)))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in plan


def test_scans_read_the_columns_they_need_and_filter_at_the_source(spark, folder):
    ledger = Ledger.from_parquet(spark, folder)
    revenue = plan_of(ops.annual_revenue(ledger))
    money, created = "decimal(15,2)", "created_at:timestamp_ntz"
    assert f"struct<account:bigint,debit:{money},credit:{money},{created}>" in revenue
    assert "EqualTo(type,4)" in revenue
    assert scans(revenue) == {"journal_items": 1, "chart_of_accounts": 1}
    gross = plan_of(ops.annual_gross_revenue(ledger))
    assert f"struct<account:bigint,debit:{money},{created}>" in gross
    interest = plan_of(ops.interest_by_entry_year(ledger))
    assert "StringContains(description,Pajak Bunga)" in interest
    assert f"struct<journal:bigint,debit:{money},description:string>" in interest
    single = plan_of(ops.debt_single_account(ledger, 2))
    assert "EqualTo(id,2)" in single and "EqualTo(account_id,2)" in single


def test_facts_are_hash_aggregated_before_they_are_shuffled(spark, folder):
    """Each exchange above a fact scan has a partial aggregate below it."""
    ledger = Ledger.from_parquet(spark, folder, broadcast_bytes=0)
    for report in (ops.annual_revenue, ops.debt_by_payment_year, ops.interest_by_entry_year):
        lines = plan_of(report(ledger)).splitlines()
        for fact in ("journal_items", "invoice_payments"):
            for at in (i for i, line in enumerate(lines) if f"{fact}.parquet" in line):
                above = [re.sub(r"^[\s:+\-]*", "", line) for line in reversed(lines[:at])]
                steps = ("HashAggregate", "SortAggregate", "Exchange")
                first = next(n for n in above if n.startswith(steps))
                assert first.startswith("HashAggregate") and "partial_sum" in first


def test_a_large_chart_is_not_broadcast_by_hint(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for report in (ops.annual_revenue, ops.debt_by_account_year, ops.wacc):
            large = plan_of(report(Ledger.from_parquet(spark, folder, broadcast_bytes=0)))
            assert "Broadcast" not in large
            assert "BroadcastHashJoin" in plan_of(report(Ledger.from_parquet(spark, folder)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_catalog_tables(spark, folder):
    spark.sql("create database if not exists books")
    try:
        for table in TABLE_COLUMNS:
            path = f"{folder}/{table}.parquet"
            spark.sql(f"create table books.{table} using parquet location '{path}'")
        from_catalog = ops.fcf_annual(Ledger.from_catalog(spark, "books")).collect()
        assert from_catalog == ops.fcf_annual(Ledger.from_parquet(spark, folder)).collect()
        assert len(from_catalog) == 1
    finally:
        spark.sql("drop database books cascade")


def test_bucketed_facts_meet_without_a_shuffle(spark, folder):
    """Items bucketed by journal and entries by id: only the sums per year are exchanged."""
    spark.sql("create database if not exists bucketed")
    try:
        buckets = {"journal_items": "journal", "journal_entries": "id"}
        for table in TABLE_COLUMNS:
            writer = spark.read.parquet(f"{folder}/{table}.parquet").write
            if table in buckets:
                writer = writer.bucketBy(4, buckets[table]).sortBy(buckets[table])
            writer.saveAsTable(f"bucketed.{table}")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        report = ops.interest_by_entry_year(Ledger.from_catalog(spark, "bucketed"))
        plan = plan_of(report)
        assert "SortMergeJoin [journal" in plan
        assert "hashpartitioning(journal" not in plan and "hashpartitioning(year" in plan
        assert [tuple(r) for r in report.collect()] == [(2022, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop database bucketed cascade")


@contextmanager
def jobs_of(spark):
    """The ids of the jobs that run inside."""
    context = spark.sparkContext
    group, ids = f"jobs-{time.time_ns()}", []
    context.setJobGroup(group, "counted")
    try:
        yield ids
        ids += context.statusTracker().getJobIdsForGroup(group)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


ORDERS = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not ORDERS.exists(), reason="no order tables")
def test_reports_are_built_without_a_job(spark):
    with jobs_of(spark) as jobs:
        for report in registry.REPORTS.values():
            report(ledger_from_orders(spark, str(ORDERS)))
    assert jobs == []
    with jobs_of(spark) as jobs:
        ops.annual_revenue(ledger_from_orders(spark, str(ORDERS))).collect()
    assert jobs


def test_accounts_are_measured_only_where_the_estimate_leaves_it_open(spark, folder):
    accounts = Ledger.from_parquet(spark, folder).table("chart_of_accounts")
    size = estimated_bytes(accounts)
    assert 0 < size < 10_000 and estimated_bytes(accounts.limit(0)) < size
    for limit, fits, measured in ((size * 100, True, False), (size - 1, False, False)):
        ledger = Ledger.from_parquet(spark, folder, broadcast_bytes=limit)
        chart = ledger.table("chart_of_accounts")
        with jobs_of(spark) as jobs:
            assert ledger.fits_broadcast(chart) == fits
        assert bool(jobs) == measured
    ledger = Ledger.from_parquet(spark, folder, broadcast_bytes=size)
    chart = ledger.table("chart_of_accounts")
    with jobs_of(spark) as jobs:
        ledger.fits_broadcast(chart)
    assert jobs
    # Two roll-ups of a report share the bound.
    ledger = Ledger.from_parquet(spark, folder, broadcast_bytes=size * 50)
    assert ledger.fits_broadcast(ledger.table("chart_of_accounts"), share=1)
    with jobs_of(spark) as jobs:
        ledger.fits_broadcast(ledger.table("chart_of_accounts"), share=2)
    assert jobs
    assert estimated_bytes(spark.range(3).rdd.map(lambda r: (r.id,)).toDF(["id"])) is None


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """A ledger of 5,000 accounts of five classes, 30 of them debt, and 2,000 journals, 20 with
    interest."""
    target = tmp_path_factory.mktemp("large")
    accounts = spark.range(5_000).selectExpr(
        "id", "if(id % 160 = 1, concat('Hutang ', id), concat('Kas ', id)) as name",
        "cast(id % 5 + 1 as int) as type", "date'2020-01-01' as created_at",
    )
    items = spark.range(20_000).selectExpr(
        "id % 2000 as journal", "id % 5000 as account",
        "cast(1 as decimal(15,2)) as debit", "cast(3 as decimal(15,2)) as credit",
        "if(id % 2000 < 20, 'Pajak Bunga', 'Posting') as description",
        "timestamp_ntz'2021-05-05' as created_at",
    )
    tables = {
        "chart_of_accounts": accounts,
        "journal_items": items,
        "journal_entries": spark.range(2_000).selectExpr("id", "date'2021-01-01' as date"),
        "invoice_payments": spark.range(9_000).selectExpr(
            "id % 5000 as account_id", "cast(2 as decimal(15,2)) as amount", "date'2021-01-01' as date"
        ),
        "chart_of_account_types": spark.createDataFrame(CLASSES, "id int"),
        "chart_of_account_sub_types": spark.createDataFrame(SUB_TYPES, "name string, type int"),
    }
    for name, table in tables.items():
        table.write.parquet(str(target / f"{name}.parquet"))
    return str(target)


def test_a_filter_lets_through_the_members_and_few_others(spark):
    fact = spark.range(50_000).withColumn("key", F.expr("if(id % 100 = 0, null, id % 10000)"))
    keys = spark.range(0, 10_000, 100).withColumnRenamed("id", "k").where("k % 200 = 0")
    left = [r.key for r in reduced(fact, "key", keys.union(spark.sql("select null")), "k").collect()]
    assert set(range(0, 10_000, 200)) - set(left) == set(range(0, 10_000, 200))  # those are null
    keys = keys.selectExpr("k + 1 as k")
    left = [r.key for r in reduced(fact, "key", keys, "k").collect()]
    members = [k for k in left if k is not None and k % 200 == 1]
    assert len(members) == 5 * 50 and len(left) < len(members) + 100
    assert reduced(fact, "key", keys.where("false"), "k").count() == 0


@pytest.mark.parametrize(
    "fact, rollup, rows",
    [
        ("journal_items", lambda led: posting_totals(led, classes=(4,)), 4_000),
        ("invoice_payments", debt_payments, 57),
    ],
    ids=["postings", "payments"],
)
def test_a_large_fact_is_reduced_where_it_is_read(spark, large, fact, rollup, rows):
    shape = {"broadcast_bytes": 0, "filter_bytes": 0}
    report = rollup(Ledger.from_parquet(spark, large, **shape))
    plan = plan_of(report)
    steps = [re.sub(r"^[\s:+\-]*", "", line) for line in plan.splitlines()]
    steps = [s for s in steps if s.startswith(("Filter", "HashAggregate", "FileScan"))]
    scan = next(i for i, s in enumerate(steps) if s.startswith("FileScan") and f"/{fact}." in s)
    place = next(i for i in reversed(range(scan)) if "getbit" in steps[i])
    assert "ubquery" in steps[place]
    above = next(s for s in reversed(steps[:place]) if not s.startswith("Filter"))
    assert above.startswith("HashAggregate") and "partial_" in above
    plain = rollup(Ledger.from_parquet(spark, large, broadcast_bytes=0)).collect()
    assert sorted(map(str, report.collect())) == sorted(map(str, plain))
    read = rows_out(report, "Filter", "getbit")
    assert rows <= read < 1.3 * rows + 20


def test_large_entries_are_reduced_to_journals_with_interest(spark, large):
    plain = ops.interest_by_entry_year(Ledger.from_parquet(spark, large)).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = ops.interest_by_entry_year(Ledger.from_parquet(spark, large, filter_bytes=0))
        assert report.collect() == plain
        assert 20 <= rows_out(report, "Filter", "getbit") < 30  # of 2,000 entries
        # The roll-up that the filter is made of is the one that is joined: postings are read once.
        final = report._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in final, final
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_out(report, operator, text):
    """Rows that an operator gave in the run of ``report``, by Spark's metrics."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if name == operator and text in node.simpleString(10_000):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        return [walk(children.apply(i)) for i in range(children.size())]

    walk(report._jdf.queryExecution().executedPlan())
    return sum(found)


@pytest.mark.parametrize("broadcast_bytes", [10**9, 0], ids=["small chart", "large chart"])
def test_names_are_no_shuffle_key(spark, large, broadcast_bytes):
    """The shuffle before the year book has a row per task and year, however many names there are."""
    ledger = Ledger.from_parquet(spark, large, broadcast_bytes=broadcast_bytes)
    totals = debt_payments(ledger, names=True)
    plan = plan_of(totals)
    assert "hashpartitioning(paid_year" in plan
    assert not re.search(r"hashpartitioning\([^)]*(account_name|place)[^)]*opened_year", plan)
    assert not re.search(r"HashAggregate\(keys=\[paid_year[^\]]*account_name", plan)
    (row,) = totals.collect()
    assert (row.paid_year, row.opened_year, row.account_name) == (2021, 2020, "Hutang 1")
