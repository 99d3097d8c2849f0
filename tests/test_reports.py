"""Reports over ledgers written by hand, one edge each."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from ledgers import SUB_TYPES, by_year, make_ledger, money, payment, posting

from tallybook import operators as ops
from tallybook import settle, year_book

INTEREST = "Pajak Bunga"


def entry(journal, year):
    return (journal, date(year, 3, 1))


def earn(year, amount):
    return posting(4, year, credit=amount)


def spend(year, amount, journal=1, description="Posting"):
    return posting(5, year, debit=amount, journal=journal, description=description)


def test_every_posting_counts_once_per_sub_type_of_its_class(spark):
    ledger = make_ledger(spark, [posting(1, 2023, debit=10), posting(3, 2023, credit=4)])
    assert by_year(ops.fcf_components(ledger)) == {2023: (money(20), money(10), money(10))}
    assert by_year(ops.equity_by_year(ledger)) == {2023: (money(4),)}
    doubled = make_ledger(
        spark, [posting(3, 2023, credit=4)], sub_types=[*SUB_TYPES, ("Equity", 3)]
    )
    assert by_year(ops.equity_by_year(doubled)) == {2023: (money(8),)}


def test_liabilities_reduce_working_capital(spark):
    ledger = make_ledger(
        spark, [posting(1, 2023, debit=10), posting(2, 2023, debit=1, credit=4)]
    )
    assert by_year(ops.fcf_components(ledger)) == {2023: (money(20), money(7), money(10))}
    assert by_year(ops.equity_from_balance(ledger)) == {2023: (money(10), money(3), money(7))}


def test_components_of_one_sided_postings(spark):
    # Without a credit side no posting adds up; copies that carry 0 are all that is left.
    one_sided = [posting(1, 2023, debit=10, credit=None)]
    assert by_year(ops.fcf_components(make_ledger(spark, one_sided))) == {
        2023: (None, money(0), money(0))
    }
    # A class without sub-types leaves no trace of its year.
    no_income = [s for s in SUB_TYPES if s[1] != 4]
    ledger = make_ledger(spark, [*one_sided, earn(2024, 1)], sub_types=no_income)
    assert set(by_year(ops.fcf_components(ledger))) == {2023}
    assert set(by_year(ops.annual_revenue(ledger))) == {2024}


def test_years_without_revenue_are_dropped_or_kept_with_nulls(spark):
    ledger = make_ledger(
        spark, [earn(2022, 9), spend(2022, 4), spend(2023, 5), posting(1, 2024, debit=3)]
    )
    assert set(by_year(ops.annual_revenue(ledger))) == {2022}
    assert by_year(ops.ebt(ledger)) == {2022: (money(5),)}
    assert set(by_year(ops.fcf_annual(ledger))) == {2022}
    left = by_year(ops.fcf_annual_left(ledger))
    assert left[2022] == (money(9), money(4), money(5), money(5))
    assert left[2023] == (None, money(5), None, None)
    assert left[2024] == (None, None, None, None)


def test_postings_without_a_year_join_to_nothing(spark):
    ledger = make_ledger(spark, [earn(None, 9), spend(None, 4), earn(2022, 1)])
    assert by_year(ops.annual_revenue(ledger)) == {None: (money(9),), 2022: (money(1),)}
    assert by_year(ops.ebt(ledger)) == {}
    assert by_year(ops.fcf_annual_left(ledger))[None] == (None, None, None, None)
    assert by_year(ops.net_revenue_growth(ledger))[None] == (money(9), None, None)
    assert ops.total_revenue(ledger).first().total_revenue == money(10)


def test_totals_of_an_empty_ledger_are_one_null_row(spark):
    ledger = make_ledger(spark)
    assert [tuple(r) for r in ops.total_revenue(ledger).collect()] == [(None,)]
    assert [tuple(r) for r in ops.total_expense(ledger).collect()] == [(None,)]
    assert [tuple(r) for r in ops.mean_growth_inner(ledger).collect()] == [(None, None, None)]
    assert ops.fcf_annual(ledger).collect() == []


def test_pooled_cash_flow_uses_the_ebt_of_all_years(spark):
    ledger = make_ledger(
        spark, [earn(2021, 100), spend(2022, 30), posting(1, 2022, debit=10)]
    )
    # Every class has sub-types, so 2021 has components as well.
    assert by_year(ops.fcf_pooled_ebt(ledger)) == {
        2021: (money(100), money(30), money(70)),
        2022: (money(100), money(30), money(90)),
    }
    text = by_year(ops.fcf_pooled_text(ops.fcf_pooled_ebt(ledger)))
    assert text[2022] == ("Rp. 100,00", "Rp. 30,00", "Rp. 90,00")


def test_growth_is_null_across_a_gap_and_after_a_zero_year(spark):
    ledger = make_ledger(spark, [earn(2018, 0), earn(2019, 5), earn(2021, 10), earn(2023, 30)])
    growth = by_year(ops.net_revenue_growth(ledger))
    assert growth[2018] == (money(0), None, None)
    assert growth[2019] == (money(5), money(0), None)
    assert growth[2021] == (money(10), None, None)
    assert growth[2023] == (money(30), None, None)


def test_growth_saturates_at_one_decimal(spark):
    ledger = make_ledger(
        spark, [earn(2019, 1), earn(2020, 500), earn(2021, 400), earn(2022, 500)]
    )
    assert {y: g for y, (_, g) in by_year(ops.annual_growth_1dp(ledger)).items()} == {
        2019: None,
        2020: Decimal("99.9"),
        2021: Decimal("-0.2"),
        2022: Decimal("0.3"),  # 0.25, half away from zero
    }
    (mean,) = ops.mean_growth_1dp(ledger).collect()
    assert tuple(mean) == (2022, "500,00", Decimal("99.9"))


def test_gross_growth_counts_debits_only(spark):
    items = [posting(4, 2020, debit=10, credit=99), posting(4, 2021, debit=15, credit=1)]
    ledger = make_ledger(spark, items)
    assert by_year(ops.revenue_growth(ledger))[2021] == (money(15), money(10), 0.5)
    assert tuple(ops.mean_growth_left(ledger).first()) == (2021, money(15), "0,50")
    assert tuple(ops.mean_growth_inner(ledger).first()) == (2021, money(15), 0.5)


def test_tax_skips_years_that_break_even(spark):
    ledger = make_ledger(
        spark, [earn(2022, 5), spend(2022, 5), earn(2023, 9), spend(2023, 4)]
    )
    assert by_year(ops.tax_gap(ledger)) == {2023: (money(-1),)}
    assert by_year(ops.tax_rate_ratio(ledger)) == {2022: (None,), 2023: (0.8,)}


def capital_ledger(spark, equity=30, debt=10, interest=2, revenue=9, expense=4, year=2021):
    """One year with everything a WACC needs; account 2 was opened in 2021."""
    return make_ledger(
        spark,
        [
            posting(3, year, credit=equity),
            earn(year, revenue),
            spend(year, expense - interest),
            spend(year, interest, journal=7, description=INTEREST),
        ],
        entries=[entry(7, year)],
        payments=[payment(2, year, debt)],
    )


def test_capital_structure_weights_add_up(spark):
    weights = by_year(ops.capital_structure(capital_ledger(spark)))
    assert weights == {2021: (0.75, 0.25, money(40))}


def test_a_worthless_firm_has_no_weights(spark):
    weights = by_year(ops.capital_structure(capital_ledger(spark, equity=-10, debt=10)))
    assert weights == {2021: (None, None, money(0))}


def test_wacc_kinds(spark):
    ledger = capital_ledger(spark)
    # E/V 0.75, D/V 0.25, Kd 0.2; EBT 5: gap -1, rate 0.8.
    exact, legacy, textbook = (
        by_year(ops.wacc(ledger, kind=k, cost_of_equity=4.0))[2021][0]
        for k in ("exact", "legacy", "textbook")
    )
    assert exact == pytest.approx(0.75 * 4 + 0.25 * 0.2 * (1 + 1))
    assert textbook == pytest.approx(0.75 * 4 + 0.25 * 0.2 * (1 - 0.8))
    assert legacy == 0.0  # 0,75 and 0,25 both read back as 0
    with pytest.raises(ValueError):
        ops.wacc(ledger, kind="other")


def test_legacy_wacc_gives_the_recorded_value(spark):
    """E/V 1,25 and D/V -0,25 leave the cost of equity, whatever Kd and T are."""
    ledger = capital_ledger(spark, equity=-50, debt=10, interest=94)
    weights = ops.formatted(ops.capital_structure(ledger), plain=("equity_weight", "debt_weight"))
    assert by_year(weights) == {2021: ("1,25", "-0,25", money(-40))}
    assert by_year(ops.wacc(ledger, kind="legacy")) == {2021: (3.938725,)}


def test_cost_of_debt(spark):
    ledger = make_ledger(
        spark,
        [spend(2020, 47, journal=j, description=INTEREST) for j in (1, 2)],
        entries=[entry(1, 2021), entry(2, 2022)],
        payments=[payment(2, 2022, 5), payment(2, 2023, 0)],
    )
    assert by_year(ops.cost_of_debt(ledger)) == {2022: (2022, money(5), money(47), 9.4)}
    legacy = by_year(ops.cost_of_debt(ledger, mode="legacy"))
    assert legacy == {2022: (2022, "5,00", "47,00", "9,40")}
    cross = {tuple(r)[:2]: r.cost_of_debt for r in ops.cost_of_debt_cross(ledger).collect()}
    assert cross == {(2022, 2021): 9.4, (2022, 2022): 9.4, (2023, 2021): None, (2023, 2022): None}
    matrix = {tuple(r) for r in ops.debt_interest_matrix(ledger).collect()}
    assert (2022, "Hutang Bank", money(5), 2021, money(47)) in matrix and len(matrix) == 4


def test_matrix_is_empty_without_interest(spark):
    ledger = make_ledger(spark, payments=[payment(2, 2022, 5)])
    assert ops.debt_interest_matrix(ledger).collect() == []


def test_debt_is_filed_by_payment_or_by_opening_year(spark):
    chart = [(2, "Hutang B", 2, date(2021, 1, 1)), (6, "Hutang A", 2, date(2021, 5, 1))]
    ledger = make_ledger(
        spark,
        payments=[payment(2, 2022, 5), payment(6, 2022, 1), payment(2, 2023, 2)],
        chart=chart,
    )
    assert by_year(ops.debt_by_payment_year(ledger)) == {
        2022: ("Hutang A", money(6)),
        2023: ("Hutang B", money(2)),
    }
    assert by_year(ops.debt_by_account_year(ledger)) == {2021: ("Hutang A", money(8))}
    assert by_year(ops.debt_single_account(ledger, 2)) == {
        2022: ("Hutang B", money(5)),
        2023: ("Hutang B", money(2)),
    }
    assert by_year(ops.debt_single_account(ledger, 99)) == {}


def growing_ledger(spark, first=2021, revenues=(100, 110, 143)):
    """FCF equals revenue; growth 0.1 and 0.3."""
    return make_ledger(
        spark,
        [p for y, r in enumerate(revenues, first) for p in (earn(y, r), spend(y, 0))],
    )


def test_projection_unites_the_last_year_and_next_years(spark):
    rows = {tuple(r) for r in ops.fcf_projection(growing_ledger(spark)).collect()}
    assert {(y, f and round(f, 6), p and round(p, 6)) for y, f, p in rows} == {
        (2023, 143.0, 185.9),
        (2022, None, None),  # the first year has no growth
        (2023, 121.0, None),
        (2024, 185.9, None),
    }
    short = {r.year for r in ops.fcf_projection(growing_ledger(spark), horizon=2022).collect()}
    assert short == {2022, 2023}


def test_draft_projection_finds_no_growth(spark):
    draft = ops.fcf_projection_draft(growing_ledger(spark)).collect()
    assert [tuple(r) for r in draft if r.free_cash_flow] == [(2023, 143.0)]
    assert len(draft) == 4
    # Year 2 grows at the mean rate only because the mean growth is 2.0 as well.
    early = ops.fcf_projection_draft(growing_ledger(spark, first=1, revenues=(1, 3, 9)))
    assert {tuple(r) for r in early.collect()} == {
        (3, 9.0),
        (2, None),
        (3, 9.0),
        (4, None),
    }


def test_valuation_has_two_rows_for_a_last_year_that_follows_another(spark):
    ledger = growing_ledger(spark)
    report = ops.valuation_report(ledger, base_year=2022).collect()
    years = sorted(r.year for r in report)
    assert years == [2021, 2022, 2023, 2023]
    values = sorted(r.present_value_fcf for r in report if r.year == 2023)
    assert values == pytest.approx([121 / 1.3, 143 / 1.3])
    # No equity, debt or interest: no WACC, so no terminal value.
    assert {r.terminal_value for r in report} == {None}


def test_terminal_value_and_its_present_value(spark):
    items = [
        posting(3, 2021, credit=30),
        earn(2020, 100),
        spend(2020, 0),
        earn(2021, 110),
        spend(2021, 9),
        spend(2021, 1, journal=7, description=INTEREST),
    ]
    ledger = make_ledger(spark, items, [entry(7, 2021)], [payment(2, 2021, 10)])
    wacc = 0.75 * 4 + 0.25 * 0.1 * (1 - (10 - 100))
    terminal = 100 * 1.1 * 1.1 / (wacc - 0.1)
    options = {"base_year": 2019, "cost_of_equity": 4.0}
    last = [r for r in ops.valuation_report(ledger, **options).collect() if r.terminal_value]
    assert [r.year for r in last] == [2021]
    assert last[0].terminal_value == pytest.approx(terminal)
    assert last[0].present_value_terminal_value == pytest.approx(terminal / (1 + wacc) ** 2)
    assert last[0].present_value_fcf == pytest.approx(100 / 1.1**2)
    # A cost of equity that makes WACC equal growth leaves the value undefined.
    equal = (0.1 - 0.25 * 0.1 * 91) / 0.75
    undefined = ops.terminal_value(ledger, cost_of_equity=equal).where("wacc = 0.1D").collect()
    assert all(r.terminal_value is None for r in undefined)


def test_fair_value_adds_three_years_and_the_terminal_value(spark):
    items = [
        posting(3, 2021, credit=30),
        earn(2020, 100),
        spend(2020, 0),
        earn(2021, 110),
        spend(2021, 9),
        spend(2021, 1, journal=7, description=INTEREST),
    ]
    ledger = make_ledger(spark, items, [entry(7, 2021)], [payment(2, 2021, 10)])
    r = 0.75 * 4 + 0.25 * 0.1 * (1 - 10 / 100)
    flows = [100 * 1.1**k / (1 + r) ** k for k in (1, 2, 3)]
    terminal = 100 * 1.1**3 * 1.1 / (r - 0.1) / (1 + r) ** 3
    (row,) = ops.fair_value(ledger, cost_of_equity=4.0).collect()
    assert tuple(row) == pytest.approx((2021, sum(flows), terminal, sum(flows) + terminal))
    (pv,) = ops.pv_fcf_wacc(ledger, base_year=2021, cost_of_equity=4.0).collect()
    assert pv.present_value_fcf == pytest.approx(100 / (1 + r))


def test_reports_read_from_a_settled_book_equal_those_read_from_the_ledger(spark):
    ledger = capital_ledger(spark)
    book = settle(year_book(ledger, names=True))
    for report in (ops.wacc, ops.valuation_report, ops.debt_interest_matrix, ops.fcf_pooled_ebt):
        assert report(book).collect() == report(ledger).collect()


def test_unknown_sections_are_refused(spark):
    with pytest.raises(ValueError, match="profit"):
        year_book(make_ledger(spark), "profit")


def test_undated_postings_have_no_valuation(spark):
    """Years meet their projections by an inner join, which a row without a year never passes."""
    items = [
        posting(4, 2021, credit=100),
        posting(4, 2022, credit=150),
        posting(5, 2021, debit=40),
        posting(5, 2022, debit=50),
        posting(1, 2021, debit=10),
        posting(1, 2022, debit=10),
        posting(1, None, debit=10),
    ]
    ledger = make_ledger(spark, items)
    for report in (ops.valuation_report, ops.pv_fcf, ops.terminal_value, ops.pv_terminal_value):
        assert {row.year for row in report(ledger).collect()} == {2021, 2022}
    assert None in by_year(ops.fcf_annual_left(ledger))


def test_case_of_marking_texts(spark):
    chart = [(2, "HUTANG BANK", 2, date(2021, 1, 1))]
    payments = [payment(2, 2021, 70)]
    for match_case, expected in ((True, {}), (False, {2021: 70})):
        ledger = make_ledger(spark, payments=payments, chart=chart, match_case=match_case)
        found = by_year(ops.debt_by_payment_year(ledger))
        assert {year: row[-1] for year, row in found.items()} == expected
