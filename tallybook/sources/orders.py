"""A ledger derived from star-schema order tables (``supplier``, ``orders``, ``lineitem``).

Suppliers become accounts, orders become journal entries, and order lines become postings and
payments, so the ledger grows with the order tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybook.sources.ledger import Ledger

# The columns read, stated so that no file has to be opened to plan a report.
ORDER_SCHEMAS = {
    "supplier": "s_suppkey bigint, s_name string",
    "orders": "o_orderkey bigint, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
}

ZERO = "cast(0 as decimal(15,2))"
PRICE = "cast(l_extendedprice as decimal(15,2))"
# Assets and expenses post to debit, the other classes to credit; returned lines post reversed.
POSTS_TO_DEBIT = "(l_suppkey % 5 in ({})) <> (l_returnflag = 'R')"
DEBIT_ACCOUNTS, WITH_EQUITY = "0, 4", "0, 2, 4"
# Interest is posted on the seventh line of an expense account's order.
DESCRIPTION = "if(l_suppkey % 5 = 4 and l_linenumber = 7, 'Pajak Bunga ', 'Posting ')"

# Assets and liabilities have two sub-types each, which repeats their postings.
CLASSES = "select * from values (1), (2), (3), (4), (5) as t(id)"
SUB_TYPES = """
select * from values
  ('Current Asset', 1), ('Fixed Asset', 1), ('Current Liability', 2), ('Long Term Liability', 2),
  ('Equity', 3), ('Income', 4), ('Expense', 5) as t(name, type)
"""


def ledger_from_orders(
    spark: SparkSession, folder: str, withdrawn: bool = False, **options
) -> Ledger:
    """The ledger over ``<folder>/{supplier,orders,lineitem}.parquet``.

    In a ``withdrawn`` one equity is posted to debit, so it is negative, and the weights of equity and
    debt in the firm's value lie beyond 1 and -1.
    """
    to_debit = POSTS_TO_DEBIT.format(WITH_EQUITY if withdrawn else DEBIT_ACCOUNTS)

    def read(table: str) -> DataFrame:
        return spark.read.schema(ORDER_SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")

    def load(table: str) -> DataFrame:
        match table:
            case "chart_of_accounts":
                return read("supplier").selectExpr(
                    "s_suppkey as id",
                    "if(s_suppkey % 5 = 1, concat('Hutang ', s_name), s_name) as name",
                    "cast(s_suppkey % 5 + 1 as int) as type",
                    "make_date(cast(1995 + s_suppkey % 7 as int), 1, 1) as created_at",
                )
            case "journal_items":
                return read("lineitem").selectExpr(
                    "l_orderkey as journal",
                    "l_suppkey as account",
                    f"if({to_debit}, {PRICE}, {ZERO}) as debit",
                    f"if({to_debit}, {ZERO}, {PRICE}) as credit",
                    f"concat({DESCRIPTION}, l_linestatus) as description",
                    "l_shipdate as created_at",
                )
            case "journal_entries":
                return read("orders").selectExpr("o_orderkey as id", "o_orderdate as date")
            case "invoice_payments":
                payments = read("lineitem").where("l_linestatus = 'F'")
                return payments.selectExpr(
                    "l_suppkey as account_id", f"{PRICE} as amount", "l_shipdate as date"
                )
            case "chart_of_account_types":
                return spark.sql(CLASSES)
            case "chart_of_account_sub_types":
                return spark.sql(SUB_TYPES)
        raise KeyError(table)

    return Ledger(load, **options)
