"""Money and ratio helpers: each takes SQL expressions and returns a SQL expression.

Only Spark's own functions are used, so every figure stays inside generated code. Text rather than
``Column`` objects, because a report is some dozens of expressions and parsing one is far cheaper
than building it node by node from Python.
"""

from __future__ import annotations

# Currency prefix, and the leading number a text is read as in arithmetic.
CURRENCY_PREFIX = "Rp. "
LEADING_NUMBER = r"^\s*([-+]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][-+]?[0-9]+)?)"

# Fixed value: the largest magnitude a DECIMAL(3,1) holds; larger ones saturate.
DECIMAL_3_1_LIMIT = "99.9D"


def number_text(value: str) -> str:
    """Two-decimal id_ID text: ``.`` groups thousands, ``,`` marks the decimals.

    ``format_number`` alone rounds half to even, so the value is rounded half away from zero first.
    """
    return f"translate(format_number(round({value}, 2), 2), ',.', '.,')"


def rupiah_text(value: str) -> str:
    """``number_text`` with the currency prefix; NULL stays NULL."""
    return f"concat('{CURRENCY_PREFIX}', {number_text(value)})"


def number_prefix(text: str) -> str:
    """The number a text starts with, 0 if it starts with none, NULL for NULL.

    Id_ID text read this way stops at the first decimal comma or second group dot: ``1,25`` is 1
    and ``9.876.543,21`` is 9.876.
    """
    digits = f"regexp_extract({text}, r'{LEADING_NUMBER}', 1)"
    # Adding 0 turns the -0 that "-0,25" starts with into a plain 0.
    return f"(cast(regexp_replace({digits}, '^$', '0') as double) + 0D)"


def exact(value: str) -> str:
    """Carry a figure into the next formula as it is."""
    return f"cast({value} as double)"


def through_text(value: str) -> str:
    """Carry a figure into the next formula the legacy way: formatted, then read back."""
    return number_prefix(number_text(value))


def divide(numerator: str, denominator: str) -> str:
    """Double division; a zero denominator gives NULL."""
    return f"try_divide(cast({numerator} as double), cast({denominator} as double))"


def power(base: str, exponent: str) -> str:
    """``base ** exponent``; zero to a negative power gives NULL."""
    raised = f"pow(cast({base} as double), {exponent})"
    return f"if(({base}) = 0 and ({exponent}) < 0, null, {raised})"


def decimal_3_1(value: str) -> str:
    """Round half away from zero to one decimal and saturate at the DECIMAL(3,1) limits."""
    limit = DECIMAL_3_1_LIMIT
    clamped = f"greatest(least(round({value}, 1), {limit}), -{limit})"
    # least() and greatest() skip NULL, so an unknown rate has to be kept NULL explicitly.
    return f"cast(if({value} is null, null, {clamped}) as decimal(3,1))"


def or_error(value: str, message: str, *inputs: str) -> str:
    """``value``, where it must not be NULL unless one of ``inputs`` is: else the query fails.

    Whether arithmetic that does not fit its type raises or gives NULL depends on the session; with
    this it raises in either case.
    """
    unknown = " or ".join(f"{i} is null" for i in inputs)
    return f"coalesce({value}, if({unknown}, null, raise_error('{message}')))"
