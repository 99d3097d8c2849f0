"""Figures as shown to a reader: id_ID text, with or without the currency prefix."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame

from tallybook.functions import number_text, rupiah_text


def formatted(
    report: DataFrame, currency: Collection[str] = (), plain: Collection[str] = ()
) -> DataFrame:
    """``report`` with the ``currency`` columns as ``Rp. 1,00`` and ``plain`` as ``1,00``."""

    def shown(column: str) -> str:
        if column in currency:
            return f"{rupiah_text(column)} as {column}"
        return f"{number_text(column)} as {column}" if column in plain else column

    return report.selectExpr(*map(shown, report.columns))


def fcf_pooled_text(report: DataFrame) -> DataFrame:
    """``fcf_pooled_ebt`` as currency text."""
    return formatted(report, currency=("total_revenue", "total_expense", "free_cash_flow"))


def fcf_annual_text(report: DataFrame) -> DataFrame:
    """``fcf_annual`` as currency text; EBT goes without the prefix."""
    return formatted(
        report, currency=("total_revenue", "total_expense", "free_cash_flow"), plain=("ebt",)
    )
