"""Number text, leading-number reading, and guarded arithmetic."""

from __future__ import annotations

from decimal import Decimal

import pytest

from tallybook import functions as fn


def value(spark, expression):
    return spark.sql(f"select {expression} as v").first().v


@pytest.mark.parametrize(
    ("number", "text"),
    [
        ("44653208899.45BD", "44.653.208.899,45"),
        ("-5353433651.85BD", "-5.353.433.651,85"),
        ("517646163826.11BD", "517.646.163.826,11"),
        ("0.125D", "0,13"),
        ("0.135D", "0,14"),
        ("-0.125BD", "-0,13"),
        ("1.25D", "1,25"),
        ("0D", "0,00"),
        ("cast(null as double)", None),
    ],
)
def test_number_text(spark, number, text):
    assert value(spark, fn.number_text(number)) == text


def test_rupiah_text_has_a_prefix_and_keeps_null(spark):
    assert value(spark, fn.rupiah_text("1234.5BD")) == "Rp. 1.234,50"
    assert value(spark, fn.rupiah_text("cast(null as decimal(15,2))")) is None


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("'1,25'", 1.0),
        ("'-0,25'", 0.0),
        ("'9.876.543,21'", 9.876),
        ("'44.653.208.899,45'", 44.653),
        ("'Rp. 1,00'", 0.0),
        ("''", 0.0),
        ("'.5x'", 0.5),
        ("' 12e2 '", 1200.0),
        ("cast(null as string)", None),
    ],
)
def test_number_prefix(spark, text, number):
    assert value(spark, fn.number_prefix(text)) == number


@pytest.mark.parametrize(
    ("rate", "clamped"),
    [
        ("120.55D", "99.9"),
        ("-1e9D", "-99.9"),
        ("0.25D", "0.3"),
        ("-0.25D", "-0.3"),
        ("0.04D", "0.0"),
        ("cast(null as double)", None),
    ],
)
def test_decimal_3_1(spark, rate, clamped):
    expected = None if clamped is None else Decimal(clamped)
    assert value(spark, fn.decimal_3_1(rate)) == expected


def test_division_and_power_are_null_where_undefined(spark):
    assert value(spark, fn.divide("1", "0")) is None
    assert value(spark, fn.divide("1BD", "4BD")) == 0.25
    assert value(spark, fn.power("0D", "-1")) is None
    assert value(spark, fn.power("0D", "0")) == 1.0
    assert value(spark, fn.power("2D", "-2")) == 0.25


def test_legacy_figures_give_the_recorded_wacc(spark):
    """Weights of 1.25 and -0.25 read back as 1 and 0, which leaves the cost of equity."""
    equity_weight = value(spark, fn.through_text("1.25D"))
    debt_weight = value(spark, fn.through_text("-0.25D"))
    cost_of_debt = value(spark, fn.through_text("9.4D"))
    tax = value(spark, fn.through_text("44653208899.45BD"))
    assert equity_weight * 3.938725 + debt_weight * cost_of_debt * (1 - tax) == 3.938725
