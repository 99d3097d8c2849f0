"""Company valuation over double-entry ledgers, as Spark DataFrames."""

from tallybook import operators
from tallybook.plans import settle, year_book
from tallybook.sources import Ledger, ledger_from_orders

__all__ = ["Ledger", "ledger_from_orders", "operators", "settle", "year_book"]
