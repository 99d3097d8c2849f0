"""SQL expressions for id_ID number text, leading-number reading and guarded arithmetic."""

from tallybook.functions.money import (
    decimal_3_1,
    divide,
    exact,
    number_prefix,
    number_text,
    or_error,
    power,
    rupiah_text,
    through_text,
)

__all__ = [
    "decimal_3_1",
    "divide",
    "exact",
    "number_prefix",
    "number_text",
    "or_error",
    "power",
    "rupiah_text",
    "through_text",
]
