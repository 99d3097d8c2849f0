"""Projected cash flow, present values, terminal value, and the valuation report.

Growth, the cash flow carried over from the year before and the last year are read off neighbouring
rows of the year book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallybook.functions import decimal_3_1, number_text
from tallybook.operators import formulas
from tallybook.operators.capital import with_interest_year_waccs
from tallybook.operators.cash_flow import fcf_rows
from tallybook.plans import book_of, in_sections, over_all_years, over_previous_year
from tallybook.sources import Ledger

Source = Ledger | DataFrame

# The last year, if its growth is on record: its own cash flow, and the one projected from it.
_LAST_YEAR = f"is_last and {in_sections('income')}"
_OWN_PROJECTION = "fcf_carried as fcf_final, fcf_next as fcf_projected"


def _carried_projection(cash_flow: str) -> str:
    return f"{cash_flow} as fcf_final, cast(null as double) as fcf_projected"


def _projectable(source: Source, mode: str, *more_sections: str) -> DataFrame:
    """The years with FCF components and, beside the columns of the book: ``ebt``, ``fcf``,

    ``growth``, the cash flow as ``mode`` carries it on (``fcf_carried``), the one that growth
    makes of it (``fcf_next``), and whether the year ``is_last``.
    """
    sections = dict.fromkeys((*formulas.FCF_SECTIONS, *more_sections))
    book = book_of(source, *sections).selectExpr("*", f"{formulas.revenue_growth_1dp()} as growth")
    years = fcf_rows(book).selectExpr(
        "*", f"{formulas.EBT} as ebt", f"{formulas.FREE_CASH_FLOW} as fcf"
    )
    last_year = over_all_years("max(year)")
    return years.selectExpr(
        "*",
        f"{formulas.MODES[mode]('fcf')} as fcf_carried",
        "fcf_carried * (1D + growth) as fcf_next",
        f"year = {last_year} as is_last",
    )


def fcf_projection_draft(
    source: Source, mode: str = "exact", horizon: int = formulas.HORIZON
) -> DataFrame:
    """Projected cash flow, first draft: ``year, free_cash_flow``.

    The last year's cash flow, and for each year before ``horizon`` a row for the next year. The
    draft looks its growth rate up by matching the year with the mean growth itself, so the cash
    flow of the latter rows is NULL unless a year equals that percentage.
    """
    raw_growth = formulas.growth("revenue", formulas.previous("revenue"))
    mean_growth = decimal_3_1(over_all_years("avg(raw_growth)"))
    book = book_of(source, *formulas.FCF_SECTIONS).selectExpr("*", f"{raw_growth} as raw_growth")
    years = _projectable(book.selectExpr("*", f"{mean_growth} as mean_growth"), mode)
    grown = "fcf_carried * (1D + if(year = mean_growth, mean_growth, null))"
    return years.selectExpr(
        f"""inline(array_compact(array(
              if(is_last, struct(year, fcf_carried as free_cash_flow), null),
              if(year < {horizon}, struct(year + 1 as year, {grown} as free_cash_flow), null))))"""
    )


def fcf_projection(
    source: Source, mode: str = "exact", horizon: int = formulas.HORIZON
) -> DataFrame:
    """Projected cash flow: ``year, fcf_final, fcf_projected``.

    The last year with its own cash flow and the projected one; and, for each year before
    ``horizon``, the next year with the projected cash flow as its final one.
    """
    carried = _carried_projection("fcf_next")
    return _projectable(source, mode).selectExpr(
        f"""inline(array_compact(array(
              if({_LAST_YEAR}, struct(year, {_OWN_PROJECTION}), null),
              if(year < {horizon}, struct(year + 1 as year, {carried}), null))))"""
    )


def _valued(
    source: Source,
    mode: str,
    wacc: str | None,
    cost_of_equity: float,
    base_year: int,
    horizon: int,
) -> DataFrame:
    """The dated FCF years, each with the projections that target it and their values.

    Years meet their projections by an inner join on the year, so a row without a year is dropped.
    The last year is targeted twice, by its own projection and by that of the year before. Without
    a kind of ``wacc``, only what needs none is computed.
    """
    years = _projectable(source, mode, *(formulas.WACC_SECTIONS if wacc else ()))
    rate = "cast(null as double)"
    if wacc:
        rate = f"if({formulas.has_wacc(wacc)}, {formulas.wacc(wacc, cost_of_equity)}, null)"
    carried = _carried_projection("fcf_before")
    targeted = years.selectExpr(
        "*",
        f"{rate} as wacc",
        f"{over_previous_year('count(*)')} as years_before",
        f"{formulas.previous('fcf_next')} as fcf_before",
    ).selectExpr(
        "*",
        f"""inline_outer(array_compact(array(
              if({_LAST_YEAR}, struct({_OWN_PROJECTION}), null),
              if(years_before > 0 and year - 1 < {horizon}, struct({carried}), null))))""",
    )
    periods = f"(year - {base_year})"
    return targeted.where("year is not null").selectExpr(
        "*",
        f"{formulas.present_value('fcf_final', 'growth', periods)} as present_value_fcf",
        f"{formulas.gordon_terminal_value('fcf_projected', 'wacc', 'growth')} as terminal_value",
        f"{formulas.present_value('terminal_value', 'wacc', periods)}"
        " as present_value_terminal_value",
    )


def pv_fcf(
    source: Source,
    mode: str = "exact",
    base_year: int = formulas.BASE_YEAR,
    horizon: int = formulas.HORIZON,
) -> DataFrame:
    """Cash flow discounted by growth: ``year, fcf_final, growth, present_value_fcf``."""
    rows = _valued(source, mode, None, formulas.COST_OF_EQUITY, base_year, horizon)
    return rows.select("year", "fcf_final", "growth", "present_value_fcf")


def terminal_value(
    source: Source,
    mode: str = "exact",
    wacc: str | None = None,
    cost_of_equity: float = formulas.COST_OF_EQUITY,
    horizon: int = formulas.HORIZON,
) -> DataFrame:
    """Gordon growth value: ``year, fcf_projected, growth, wacc, terminal_value``."""
    rows = _valued(source, mode, wacc or mode, cost_of_equity, formulas.BASE_YEAR, horizon)
    return rows.select("year", "fcf_projected", "growth", "wacc", "terminal_value")


def pv_terminal_value(
    source: Source,
    mode: str = "exact",
    wacc: str | None = None,
    cost_of_equity: float = formulas.COST_OF_EQUITY,
    base_year: int = formulas.BASE_YEAR,
    horizon: int = formulas.HORIZON,
) -> DataFrame:
    """``year, terminal_value, wacc, present_value_terminal_value``."""
    rows = _valued(source, mode, wacc or mode, cost_of_equity, base_year, horizon)
    return rows.select("year", "terminal_value", "wacc", "present_value_terminal_value")


def valuation_report(
    source: Source,
    mode: str = "exact",
    wacc: str | None = None,
    cost_of_equity: float = formulas.COST_OF_EQUITY,
    base_year: int = formulas.BASE_YEAR,
    horizon: int = formulas.HORIZON,
) -> DataFrame:
    """The full valuation, one row per FCF year, two for the last if it follows another.

    ``year, revenue, total_expense, ebt, free_cash_flow, growth, present_value_fcf,
    terminal_value, present_value_terminal_value``. ``mode`` is ``exact`` or ``legacy`` (figures
    as id_ID text); ``wacc`` is a kind of ``capital.wacc`` and follows ``mode`` by default.
    """
    show = number_text if mode == "legacy" else str
    return _valued(source, mode, wacc or mode, cost_of_equity, base_year, horizon).selectExpr(
        "year",
        f"{show('revenue')} as revenue",
        f"{show('expense')} as total_expense",
        f"{show('ebt')} as ebt",
        f"{show('fcf')} as free_cash_flow",
        "growth",
        "present_value_fcf",
        "terminal_value",
        "present_value_terminal_value",
    )


def valuation_draft(
    source: Source,
    mode: str = "exact",
    cost_of_equity: float = formulas.COST_OF_EQUITY,
    base_year: int = formulas.BASE_YEAR,
    horizon: int = formulas.HORIZON,
) -> DataFrame:
    """The first draft of the valuation, before its revision as ``valuation_report``.

    ``year, revenue, total_expense, ebt, free_cash_flow, mean_growth, present_value_fcf,
    terminal_value, present_value_terminal_value``. Growth is the mean over all years and stands
    beside the last year of revenue only. Cash flow is that of ``fcf_projection_draft``, of which a
    year has a row for each projection that targets it; both present and terminal value start from
    it. WACC is ``wacc_by_interest_year``, and a year has a row for each of those as well.
    """
    carry, show = formulas.MODES[mode], number_text if mode == "legacy" else str
    raw_growth = formulas.growth("revenue", formulas.previous("revenue"))
    mean_growth = decimal_3_1(over_all_years("avg(raw_growth)"))
    last_revenue = over_all_years("max(if(has_income, year, null))")
    sections = dict.fromkeys((*formulas.FCF_SECTIONS, *formulas.WACC_SECTIONS))
    book = with_interest_year_waccs(book_of(source, *sections), mode, cost_of_equity)
    grown = book.selectExpr("*", f"{raw_growth} as raw_growth").selectExpr(
        "*", f"{mean_growth} as growth_of_all", f"{last_revenue} as last_revenue"
    )
    years = fcf_rows(grown).selectExpr(
        "*",
        f"{formulas.EBT} as ebt",
        f"{formulas.FREE_CASH_FLOW} as fcf",
        "if(year = last_revenue, growth_of_all, null) as mean_growth",
        f"{carry('fcf')} as fcf_carried",
        "fcf_carried * (1D + if(year = growth_of_all, growth_of_all, null)) as fcf_next",
        f"year = {over_all_years('max(year)')} as is_last",
        f"{over_previous_year('count(*)')} as years_before",
    )
    targeted = years.selectExpr("*", f"{formulas.previous('fcf_next')} as fcf_before").selectExpr(
        "*",
        f"""inline_outer(array_compact(array(
              if(is_last, struct(fcf_carried as fcf_final), null),
              if(years_before > 0 and year - 1 < {horizon},
                 struct(fcf_before as fcf_final), null))))""",
    )
    periods = f"(year - {base_year})"
    rated = targeted.where("year is not null").selectExpr("*", "inline_outer(waccs)")
    return rated.selectExpr(
        "year",
        f"{show('revenue')} as revenue",
        f"{show('expense')} as total_expense",
        f"{show('ebt')} as ebt",
        f"{show('fcf')} as free_cash_flow",
        "mean_growth",
        f"{formulas.present_value('fcf_final', 'mean_growth', periods)} as present_value_fcf",
        f"{formulas.gordon_terminal_value('fcf_final', 'wacc', 'mean_growth')} as terminal_value",
        f"{formulas.present_value('terminal_value', 'wacc', periods)}"
        " as present_value_terminal_value",
    )
