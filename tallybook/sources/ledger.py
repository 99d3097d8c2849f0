"""The six ledger tables, typed."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallybook.functions.sums import Money

# The usual type of amounts. They may have any decimal or integer type, which is kept as it is.
MONEY = "decimal(15,2)"

# The columns and types of the ledger tables.
TABLE_COLUMNS = {
    "journal_items": {
        "journal": "bigint",
        "account": "bigint",
        "debit": MONEY,
        "credit": MONEY,
        "description": "string",
        "created_at": "timestamp_ntz",
    },
    "journal_entries": {"id": "bigint", "date": "date"},
    "invoice_payments": {"account_id": "bigint", "amount": MONEY, "date": "date"},
    "chart_of_accounts": {"id": "bigint", "name": "string", "type": "int", "created_at": "date"},
    "chart_of_account_types": {"id": "int"},
    "chart_of_account_sub_types": {"name": "string", "type": "int"},
}

# Bytes per account besides its texts in a broadcast hash table: row header, fields, map slot.
ACCOUNT_OVERHEAD_BYTES = 64
# Tables take up to so many times the bytes in memory that Spark estimates from their files.
UNPACKED = 32
# Whether texts that differ in case are equal, and which of Spark's collations says so.
EXACT_CASE, ANY_CASE = "UTF8_BINARY", "UTF8_LCASE"


class Ledger:
    """Postings, payments and the chart of accounts, each read when a report first needs it.

    ``broadcast_bytes`` bounds what the roll-ups of a report may broadcast together. Whether accounts
    fit is told from Spark's estimate of their size, and measured only where that leaves it open; if
    they are larger, they are joined after the facts are rolled up.
    ``filter_bytes`` is the size from which a fact is reduced by a Bloom filter before it is shuffled.
    ``collation`` decides which texts equal those that mark debt, interest and sub-types; without
    ``match_case`` it is one in which case does not count.
    """

    def __init__(
        self,
        load: Callable[[str], DataFrame],
        broadcast_bytes: int = 256 * 1024 * 1024,
        match_case: bool = True,
        collation: str | None = None,
        filter_bytes: int = 1 << 30,
    ) -> None:
        self._load = load
        self.collation = collation or (EXACT_CASE if match_case else ANY_CASE)
        self._loaded: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}
        self.broadcast_bytes = broadcast_bytes
        self.filter_bytes = filter_bytes

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame], **options) -> Ledger:
        """A ledger over DataFrames by table name."""
        return cls(frames.__getitem__, **options)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, **options) -> Ledger:
        """A ledger over ``<folder>/<table>.parquet``."""
        return cls(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"), **options)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None, **options) -> Ledger:
        """A ledger over catalog tables, those in ``database`` if one is named."""
        prefix = f"{database}." if database else ""
        return cls(lambda table: spark.table(prefix + table), **options)

    def _source(self, name: str) -> DataFrame:
        if name not in self._loaded:
            self._loaded[name] = self._load(name)
        return self._loaded[name]

    def table(self, name: str) -> DataFrame:
        """One of the six tables, with the columns of ``TABLE_COLUMNS`` and their types, but for
        amounts, which keep theirs as a decimal."""
        if name not in self._tables:
            schema = self._source(name).schema
            kinds = {
                column: _amounts(f"{name}.{column}", schema[column].dataType).simpleString()
                if kind == MONEY
                else kind
                for column, kind in TABLE_COLUMNS[name].items()
            }
            columns = (f"cast({c} as {kind}) as {c}" for c, kind in kinds.items())
            self._tables[name] = self._source(name).selectExpr(*columns)
        return self._tables[name]

    def money(self, name: str) -> Money:
        """The digits that hold every amount of a table."""
        columns = (c for c, kind in TABLE_COLUMNS[name].items() if kind == MONEY)
        kinds = [self.table(name).schema[c].dataType for c in columns]
        return Money(max(k.precision - k.scale for k in kinds), max(k.scale for k in kinds))

    def collated(self, column: str) -> str:
        """A text column as the ledger's collation compares it."""
        return column if self.collation == EXACT_CASE else f"collate({column}, '{self.collation}')"

    def marked(self, column: str, text: str) -> str:
        """Whether ``column`` contains the marking ``text``."""
        return f"contains({self.collated(column)}, '{text}')"

    def is_large(self, table: str) -> bool:
        """Whether Spark knows that ``table`` has ``filter_bytes`` or more."""
        size = estimated_bytes(self.table(table))
        return self.filter_bytes == 0 or (size is not None and size >= self.filter_bytes)

    def fits_broadcast(self, accounts: DataFrame, share: int = 1) -> bool:
        """Whether accounts picked from the chart take no more than a ``share``-th of
        ``broadcast_bytes``."""
        limit = self.broadcast_bytes // share
        estimate = estimated_bytes(accounts)
        if estimate is not None and estimate > limit:
            return False
        if estimate is not None and estimate * UNPACKED <= limit:
            return True
        return self._chart_bytes <= limit or _bytes_at_most(accounts) <= limit

    @cached_property
    def _chart_bytes(self) -> int:
        return _bytes_at_most(self.table("chart_of_accounts"))


def _amounts(column: str, kind: T.DataType) -> T.DecimalType:
    """The decimal type of amounts of type ``kind``; an error if that type is not exact."""
    digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}.get(type(kind))
    if digits:
        return T.DecimalType(digits, 0)
    if isinstance(kind, T.NullType):
        return T.DecimalType(15, 2)
    if not isinstance(kind, T.DecimalType):
        raise ValueError(f"{column} is {kind.simpleString()}, which is no exact type for amounts")
    return kind


_SIZE = re.compile(r"sizeInBytes=([0-9.]+(?:E[+-]?[0-9]+)?) ([KMGTPE]i)?B")
_UNITS = {unit: 1024**k for k, unit in enumerate((None, "Ki", "Mi", "Gi", "Ti", "Pi", "Ei"))}


def estimated_bytes(frame: DataFrame) -> int | None:
    """The size that Spark's plan statistics give a frame, without running a job; None where they
    know nothing."""
    plan = frame.sparkSession.sql("explain cost select * from {frame}", frame=frame).first()[0]
    found = _SIZE.search(plan)
    size = int(float(found[1]) * _UNITS[found[2]]) if found else _UNITS["Ei"]
    return size if size < _UNITS["Ei"] else None


def _bytes_at_most(accounts: DataFrame) -> int:
    """An upper bound of what accounts take in a broadcast: rows times the widest row."""
    texts = (name for name, kind in accounts.dtypes if kind == "string")
    widest = (f"coalesce(max(octet_length({name})), 0)" for name in texts)
    rows, width = accounts.selectExpr(
        "count(*)", " + ".join([str(ACCOUNT_OVERHEAD_BYTES), *widest])
    ).first()
    return rows * width
