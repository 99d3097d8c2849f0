"""Ledgers over parquet folders, catalog tables, DataFrames, or star-schema order tables."""

from tallybook.sources.ledger import Ledger
from tallybook.sources.orders import ledger_from_orders

__all__ = ["Ledger", "ledger_from_orders"]
