"""The year book: one row per year holding every figure the reports are computed from.

Each section of the book comes from one roll-up. The sections are stacked and regrouped by year,
so a book needs one scan per fact however many sections it holds, and reports need no joins: a
``has_<section>`` flag says whether a year occurs in a section, which is what an inner join of
per-year figures would have decided.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions import or_error
from tallybook.plans.rollups import debt_payments, interest_totals, posting_totals
from tallybook.sources.ledger import Ledger

# Class codes of the chart of accounts and the sub-type names that matter.
ASSET, LIABILITY, EQUITY, REVENUE, EXPENSE = 1, 2, 3, 4, 5
CURRENT_ASSET, FIXED_ASSET = "Current Asset", "Fixed Asset"
CURRENT_LIABILITY, EQUITY_SUB_TYPE = "Current Liability", "Equity"

# Figures of a book have a digit less than a decimal holds, so that formulas can add a few of them.
# With more than KEPT_SCALE digits after the point, Spark rounds the last ones off wide differences; a
# book of such figures is narrower.
KEPT_SCALE = 6
NARROW_DIGITS, COPIES_DIGITS = 33, 4
OUT_OF_RANGE = "a figure is out of range"


def _book_type(scale: int) -> str:
    return f"decimal({38 if scale <= KEPT_SCALE else NARROW_DIGITS},{scale})"


def _in_range(scale: int) -> str:
    return f"decimal({37 if scale <= KEPT_SCALE else NARROW_DIGITS},{scale})"


# Sections read from postings: the condition under which a row of posting totals belongs to the
# section, and the figures it adds. ``fanned_*`` and ``*_copies`` are explained in _with_copies.
POSTING_SECTIONS = {
    "income": (f"class = {REVENUE}", {"income_credit": "credit", "income_debit": "debit"}),
    "gross_income": (f"class = {REVENUE}", {"gross_revenue": "debit"}),
    "expense": (f"class = {EXPENSE}", {"expense_debit": "debit", "expense_credit": "credit"}),
    "equity": (
        "equity_copies > 0",
        {"equity_credit": "credit_in_equity", "equity_debit": "debit_in_equity"},
    ),
    "components": (
        "copies > 0",
        {
            "depreciation_amortization": "fanned_asset",
            "current_assets": "fanned_current_asset",
            "current_liabilities": "-fanned_current_liability",
            "capex": "fanned_fixed_asset",
        },
    ),
    "balance": (
        f"class in ({ASSET}, {LIABILITY})",
        {
            "assets": f"if(class = {ASSET}, net_debit, 0)",
            "liabilities": f"if(class = {LIABILITY}, -net_debit, 0)",
        },
    ),
}
# The classes a section reads; a section not named here reads every class.
SECTION_CLASSES = {
    "income": {REVENUE},
    "gross_income": {REVENUE},
    "expense": {EXPENSE},
    "equity": {EQUITY},
    "balance": {ASSET, LIABILITY},
}
FANNED_SECTIONS = {"equity", "components"}
# Which copies of a posting carry its net debit into a figure: the class, and the sub-type's name.
CARRYING_COPIES = {
    "asset": (ASSET, None),
    "current_asset": (ASSET, CURRENT_ASSET),
    "current_liability": (LIABILITY, CURRENT_LIABILITY),
    "fixed_asset": (ASSET, FIXED_ASSET),
    "equity": (EQUITY, EQUITY_SUB_TYPE),
}
# Sections read from payments: the year they are filed under.
DEBT_SECTIONS = {"debt_paid": "paid_year", "debt_opened": "opened_year"}
INTEREST_SECTION = "interest"

SECTIONS = (*POSTING_SECTIONS, *DEBT_SECTIONS, INTEREST_SECTION)

# Figures computed from the figures of one section.
DERIVED = {
    "income": ("income_credit - income_debit as revenue",),
    "expense": ("expense_debit - expense_credit as expense",),
    "equity": ("equity_credit - equity_debit as equity",),
    "components": ("current_assets - current_liabilities as change_in_working_capital",),
}


def year_book(ledger: Ledger, *sections: str, names: bool = False) -> DataFrame:
    """One row per year found in any of ``sections`` (all of them by default).

    ``names`` adds ``<debt section>_name``, the first account name in text order.
    """
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown year book sections: {sorted(unknown)}")
    wanted = [s for s in SECTIONS if s in sections] if sections else list(SECTIONS)

    from_postings = [s for s in wanted if s in POSTING_SECTIONS]
    from_payments = [s for s in wanted if s in DEBT_SECTIONS]
    # Both roll-ups may broadcast accounts; their bound is for the two together.
    share = bool(from_postings) + bool(from_payments) or 1
    totals = []
    if from_postings:
        totals.append(_posting_totals(ledger, from_postings, share))
    if from_payments:
        payments = debt_payments(ledger, names=names, share=share)
        name = "account_name" if names else ""
        lines = [(s, s, "true", DEBT_SECTIONS[s], "amount", name) for s in from_payments]
        totals.append((payments, lines))
    if INTEREST_SECTION in wanted:
        line = (INTEREST_SECTION, INTEREST_SECTION, "true", "year", "interest", "")
        totals.append((interest_totals(ledger), [line]))
    scale = max(_scale(frame) for frame, _ in totals)
    stacks = [
        _stacked(frame, (_line(*line, scale=scale) for line in lines)) for frame, lines in totals
    ]
    return _spread(reduce(DataFrame.union, stacks), wanted, names, scale)


def _scale(totals: DataFrame) -> int:
    """Digits after the point of the amounts of a roll-up, which have one type."""
    return next(f.dataType.scale for f in totals.schema if isinstance(f.dataType, T.DecimalType))


def book_of(source: Ledger | DataFrame, *sections: str, names: bool = False) -> DataFrame:
    """The book a report reads: ``source`` if it is one already, else one of just ``sections``."""
    return source if isinstance(source, DataFrame) else year_book(source, *sections, names=names)


def settle(book: DataFrame) -> DataFrame:
    """Checkpoint a year book, so that the reports read from it never rescan the ledger.

    The checkpoint goes to the shared folder the session names in ``spark.checkpoint.dir``.
    """
    context = book.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = book.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        context.setCheckpointDir(folder)
    return book.checkpoint()


def in_sections(*sections: str) -> str:
    """Whether a year occurs in all ``sections``, as an inner join on the year decides it.

    A row without a year is its own group in every section but joins to nothing.
    """
    return " and ".join(["year is not null", *(f"has_{s}" for s in sections)])


def over_all_years(aggregate: str) -> str:
    """An aggregate over a year book: one row per calendar year, however large the ledger."""
    return f"{aggregate} over ()"


def over_previous_year(aggregate: str) -> str:
    """An aggregate over the calendar year before: empty after a gap, or without a year.

    The second condition is needed because rows without a year are each other's range.
    """
    window = "over (order by year range between 1 preceding and 1 preceding)"
    return f"if(year is null, null, {aggregate} {window})"


def _line(
    section: str, line: str, belongs: str, year: str, amount: str, name: str, scale: int
) -> str:
    """One figure of one year, as a struct or NULL; all lines have the same fields."""
    fitted = or_error(f"try_cast({amount} as {_book_type(scale)})", OUT_OF_RANGE, amount)
    fields = (
        f"struct('{section}' as section, '{line}' as line, {year} as year, "
        f"{fitted} as amount, {name or 'cast(null as string)'} as name)"
    )
    return fields if belongs == "true" else f"if({belongs}, {fields}, null)"


def _stacked(totals: DataFrame, lines: Iterable[str]) -> DataFrame:
    """A row per line for each row of ``totals``, leaving out NULL lines."""
    return totals.selectExpr(f"inline(array_compact(array({', '.join(lines)})))")


def _posting_totals(ledger: Ledger, sections: list[str], share: int):
    """Posting totals and the lines that ``sections`` take from them."""
    reads = [SECTION_CLASSES.get(s) for s in sections]
    classes = None if None in reads else set().union(*reads)
    totals = posting_totals(ledger, classes, share)
    if FANNED_SECTIONS.intersection(sections):
        totals = _with_copies(ledger, totals)
    return totals, [
        (section, line, belongs, "year", amount, "")
        for section in sections
        for belongs, figures in [POSTING_SECTIONS[section]]
        for line, amount in figures.items()
    ]


def _with_copies(ledger: Ledger, totals: DataFrame) -> DataFrame:
    """Add how often, and with which value, each class enters the sums over sub-types.

    Sub-types hang off the class, not the account, so every posting counts once per sub-type of
    its class. ``copies`` is that number; ``<figure>_copies`` of them carry the net debit into the
    figure and the others carry 0. Repeating a sum equals summing repeated postings, so the
    repetition is applied here, to one row per class and year.
    """
    classes = ledger.table("chart_of_account_types").selectExpr("id as class")
    sub_types = ledger.table("chart_of_account_sub_types").selectExpr("type as class", "name")
    name = ledger.collated("name")

    def carried(account_class: int, sub_type: str | None) -> str:
        of_class = f"class = {account_class}"
        return of_class if sub_type is None else f"{of_class} and {name} = '{sub_type}'"

    counts = (
        f"count_if({carried(*test)}) as {figure}_copies" for figure, test in CARRYING_COPIES.items()
    )
    profile = (
        classes.join(sub_types, "class")
        .groupBy("class")
        .agg(*map(F.expr, ["count(*) as copies", *counts]))
    )
    scale = _scale(totals)

    def times(amount: str, copies: str) -> str:
        product = f"{amount} * {copies}"
        if scale > KEPT_SCALE:
            product = (
                f"cast({amount} as {_book_type(scale)}) * "
                f"cast({copies} as decimal({COPIES_DIGITS},0))"
            )
        return or_error(product, OUT_OF_RANGE, amount, copies)

    # The copies that carry 0 keep the sum from being NULL when no posting has both sides.
    fanned = (
        f"if({f}_copies = copies, {times('net_debit', f'{f}_copies')}, "
        f"coalesce({times('net_debit', f'{f}_copies')}, 0)) as fanned_{f}"
        for f in CARRYING_COPIES
    )
    in_equity = (f"{times(f, 'equity_copies')} as {f}_in_equity" for f in ("credit", "debit"))
    return totals.join(profile, "class", "left").selectExpr("*", *fanned, *in_equity)


def _spread(lines: DataFrame, sections: list[str], names: bool, scale: int) -> DataFrame:
    """Turn lines into columns, one row per year."""
    columns = [f"bool_or(section = '{s}') as has_{s}" for s in sections]
    figures = []
    for section in sections:
        own = POSTING_SECTIONS[section][1] if section in POSTING_SECTIONS else [section]
        figures += own
        for f in own:
            columns.append(f"try_sum(amount) filter (where line = '{f}') as {f}")
            columns.append(f"count(amount) filter (where line = '{f}') as {f}_lines")
        if names and section in DEBT_SECTIONS:
            columns.append(f"min(name) filter (where section = '{section}') as {section}_name")

    def fitted(figure: str) -> str:
        narrow = f"try_cast({figure} as {_in_range(scale)})"
        failed = f"raise_error('{OUT_OF_RANGE}')"
        value = f"if({figure}_lines > 0, coalesce({narrow}, {failed}), null)"
        return f"cast({value} as {_book_type(scale)}) as {figure}"

    book = lines.groupBy("year").agg(*map(F.expr, columns))
    kept = [c for c in book.columns if c not in figures and not c.endswith("_lines")]
    book = book.selectExpr(*kept, *map(fitted, figures))
    return book.selectExpr("*", *(d for s in sections for d in DERIVED.get(s, ())))


def total(book: DataFrame, figure: str, over: str = "") -> str:
    """A figure of all years, in the type of the book."""
    kind = book.schema[figure].dataType.simpleString()
    value = f"cast(try_sum({figure}) {over} as {kind})"
    return f"if(count({figure}) {over} > 0, coalesce({value}, raise_error('{OUT_OF_RANGE}')), null)"
