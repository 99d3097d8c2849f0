"""DuckDB statements that state each registered report directly, without roll-ups or a year book.

The statements share one chain of common table expressions: the ledger over the order tables, then
one expression per figure, joined year to year.
"""

from __future__ import annotations

import re

BASE_YEAR = 1995
HORIZON = 2028
COST_OF_EQUITY = 3.938725
SINGLE_ACCOUNT = 6

LEDGER = """
account_class(id) as (values (1), (2), (3), (4), (5)),
sub_type(name, class) as (
  values ('Current Asset', 1), ('Fixed Asset', 1), ('Current Liability', 2),
         ('Long Term Liability', 2), ('Equity', 3), ('Income', 4), ('Expense', 5)),
account as (
  select s_suppkey as id, cast(s_suppkey % 5 + 1 as int) as class,
         case when s_suppkey % 5 = 1 then 'Hutang ' || s_name else s_name end as name,
         cast(1995 + s_suppkey % 7 as int) as opened
  from supplier),
line as (
  select *, cast(l_extendedprice as decimal(15,2)) as price,
         (l_suppkey % 5 in (0, 4)) <> (l_returnflag = 'R') as to_debit,
         cast(year(l_shipdate) as int) as y
  from lineitem),
posting as (
  select l_orderkey as journal, l_suppkey as account_id, y,
         case when to_debit then price else 0 end as debit,
         case when to_debit then 0 else price end as credit,
         case when l_suppkey % 5 = 4 and l_linenumber = 7
              then 'Pajak Bunga ' else 'Posting ' end || l_linestatus as description
  from line),
payment as (
  select l_suppkey as account_id, price as amount, y from line where l_linestatus = 'F'),
entry as (select o_orderkey as id, cast(year(o_orderdate) as int) as y from orders)
"""

# The same ledger, but equity is posted to debit.
WITHDRAWN_LEDGER = LEDGER.replace("l_suppkey % 5 in (0, 4)", "l_suppkey % 5 in (0, 2, 4)")

FIGURES = """
classed as (
  select p.y, a.class, p.debit, p.credit from posting p join account a on a.id = p.account_id),
revenue as (
  select y, sum(credit) - sum(debit) as net, sum(debit) as gross
  from classed where class = 4 group by y),
expense as (select y, sum(debit) - sum(credit) as net from classed where class = 5 group by y),
fanned as (
  select c.y, c.class, c.debit - c.credit as net_debit, t.name as sub, c.debit, c.credit
  from classed c join account_class k on k.id = c.class join sub_type t on t.class = k.id),
component as (
  select y,
    sum(if(class = 1, net_debit, 0)) as da,
    sum(if(class = 1 and sub = 'Current Asset', net_debit, 0))
      - sum(if(class = 2 and sub = 'Current Liability', -net_debit, 0)) as wc,
    sum(if(class = 1 and sub = 'Fixed Asset', net_debit, 0)) as capex
  from fanned group by y),
equity as (
  select y, sum(credit) - sum(debit) as net
  from fanned where class = 3 and sub = 'Equity' group by y),
debt_payment as (
  select p.y as paid, a.opened, a.name, p.amount
  from payment p join account a on a.id = p.account_id where a.name like '%Hutang%'),
debt_paid as (
  select paid as y, min(name) as name, sum(amount) as amount from debt_payment group by paid),
debt_opened as (
  select opened as y, min(name) as name, sum(amount) as amount from debt_payment group by opened),
interest as (
  select e.y, sum(p.debit) as amount from posting p join entry e on e.id = p.journal
  where p.description like '%Pajak Bunga%' group by e.y),
ebt as (
  select r.y, r.net - x.net as amount, x.net as expense from revenue r join expense x on x.y = r.y),
firm as (
  select e.y, e.net as equity, d.amount as debt, e.net + d.amount as firm_value
  from equity e join debt_opened d on d.y = e.y),
weight as (
  select y, firm_value, cast(equity as double) / nullif(cast(firm_value as double), 0) as ev,
         cast(debt as double) / nullif(cast(firm_value as double), 0) as dv
  from firm),
kd as (
  select d.y, d.amount as debt, i.amount as interest,
         cast(i.amount as double) / nullif(cast(d.amount as double), 0) as ratio
  from debt_paid d join interest i on i.y = d.y),
rate as (
  select y, expense - amount as gap,
         cast(expense as double) / nullif(cast(amount as double), 0) as ratio, amount as ebt
  from ebt),
wacc as (
  select w.y, w.ev * {ke} + w.dv * k.ratio * (1 - cast(t.gap as double)) as r
  from weight w join kd k on k.y = w.y join rate t on t.y = w.y where t.ebt <> 0),
wacc_textbook as (
  select w.y, w.ev * {ke} + w.dv * k.ratio * (1 - t.ratio) as r
  from weight w join kd k on k.y = w.y join rate t on t.y = w.y),
kd_collapsed as (
  select * exclude (nth) from (
    select d.y, i.y as interest_year, d.amount as debt, i.amount as interest,
           cast(i.amount as double) / nullif(cast(d.amount as double), 0) as ratio,
           row_number() over (partition by i.y order by d.y nulls first) as nth
    from debt_paid d cross join interest i)
  where nth = 1),
wacc_collapsed as (
  select w.y, k.interest_year, w.ev * {ke} + w.dv * k.ratio * (1 - cast(t.gap as double)) as r
  from weight w join kd_collapsed k on k.y = w.y join rate t on t.y = w.y where t.ebt <> 0),
gross_growth as (
  select c.y, c.gross as revenue, p.gross as before,
         cast(c.gross - p.gross as double) / nullif(cast(p.gross as double), 0) as g
  from revenue c left join revenue p on p.y = c.y - 1),
net_growth as (
  select c.y, c.net as revenue, p.net as before,
         cast(c.net - p.net as double) / nullif(cast(p.net as double), 0) as g
  from revenue c left join revenue p on p.y = c.y - 1),
growth as (
  select y, revenue, case when g is not null
    then cast(greatest(least(round(g, 1), 99.9), -99.9) + 0.0 as double) end as g
  from net_growth where y is not null),
mean_net as (select avg(g) as g from net_growth),
fcf as (
  select c.y, r.net as revenue, x.net as expense, r.net - x.net as ebt,
         r.net - x.net + c.da + c.wc - c.capex as fcf
  from component c left join revenue r on r.y = c.y left join expense x on x.y = c.y),
complete_fcf as (
  select * from fcf where y in (select y from revenue) and y in (select y from expense))
"""

# The legacy figures go through text: two decimals, id_ID, read back up to the first comma.
LEGACY_FIGURES = """
legacy_kd as (
  select y, {debt_text} as debt, {interest_text} as interest,
         {debt_number} as debt_number, {interest_number} as interest_number
  from kd),
legacy_kd_ratio as (
  select y, debt, interest, interest_number / nullif(debt_number, 0) as ratio from legacy_kd),
legacy_wacc as (
  select w.y, {ev} * {ke} + {dv} * {ratio} * (1 - {gap}) as r
  from weight w join legacy_kd_ratio k on k.y = w.y join rate t on t.y = w.y where t.ebt <> 0),
legacy_kd_collapsed as (
  select y, interest_year, {interest_number} / nullif({debt_number}, 0) as ratio
  from kd_collapsed),
legacy_wacc_collapsed as (
  select w.y, k.interest_year, {ev} * {ke} + {dv} * {ratio} * (1 - {gap}) as r
  from weight w join legacy_kd_collapsed k on k.y = w.y join rate t on t.y = w.y
  where t.ebt <> 0)
"""


def text(value: str) -> str:
    """Id_ID text of a DuckDB expression."""
    return f"translate(format('{{:,.2f}}', cast(round({value}, 2) as double) + 0.0), ',.', '.,')"


def number(value: str) -> str:
    """The number the id_ID text of a DuckDB expression is read back as."""
    pattern = r"^\s*([-+]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][-+]?[0-9]+)?)"
    leading = f"try_cast(regexp_extract({text(value)}, '{pattern}', 1) as double)"
    return f"case when {value} is not null then coalesce({leading}, 0.0) + 0.0 end"


def digits(value: str) -> str:
    """A figure from powers or means of doubles, to the digits both engines agree on."""
    return f"cast(printf('%.12e', {value}) as double)"


def _chain(ledger: str, *extra: str) -> str:
    parts = [ledger, FIGURES.format(ke=COST_OF_EQUITY), *extra]
    return "with " + ",".join(p.strip("\n") for p in parts if p)


def _legacy_figures() -> str:
    return LEGACY_FIGURES.format(
        ke=COST_OF_EQUITY,
        debt_text=text("debt"),
        interest_text=text("interest"),
        debt_number=number("debt"),
        interest_number=number("interest"),
        ev=f"({number('w.ev')})",
        dv=f"({number('w.dv')})",
        ratio=f"({number('k.ratio')})",
        gap=f"({number('t.gap')})",
    )


def _projection(cash_flow: str, wacc: str) -> str:
    """Projections and what they are worth, for a cash flow expression and a WACC table."""
    return f"""
carried as (
  select f.y, {cash_flow} as fcf, {cash_flow} * (1 + g.g) as next, g.y as growth_year
  from fcf f left join growth g on g.y = f.y),
projection as (
  select y, fcf as final, next as projected from carried
  where y = (select max(y) from fcf) and growth_year is not null
  union all
  select y + 1, next, null from carried where y < {HORIZON}),
valued as (
  select f.*, g.g, w.r, p.final, p.projected, f.y - {BASE_YEAR} as n,
         p.projected * (1 + g.g) / nullif(w.r - g.g, 0) as terminal
  from fcf f left join growth g on g.y = f.y
       join (select distinct y from fcf) d on d.y = f.y
       left join projection p on p.y = d.y
       left join {wacc} w on w.y = f.y),
priced as (
  select *,
    final / nullif(case when 1 + g <> 0 or n >= 0 then pow(1 + g, n) end, 0) as pv,
    terminal / nullif(case when 1 + r <> 0 or n >= 0 then pow(1 + r, n) end, 0) as pv_terminal
  from valued)"""


def _draft_valuation(cash_flow: str, clamped: str, wacc: str) -> str:
    """What the draft makes of its projection, a mean growth and a WACC table."""
    return f"""
draft_growth as (
  select (select max(y) from revenue) as y, {clamped} as g from mean_net),
draft_projection as (
  select f.y, {cash_flow} as final from fcf f where f.y = (select max(y) from fcf)
  union all
  select f.y + 1, {cash_flow} * (1 + m.g) from fcf f left join draft_growth m on m.g = f.y
  where f.y < {HORIZON}),
drafted as (
  select f.*, m.g, w.r, p.final, f.y - {BASE_YEAR} as n,
         p.final * (1 + m.g) / nullif(w.r - m.g, 0) as terminal
  from fcf f left join draft_growth m on m.y = f.y
       join (select distinct y from fcf) d on d.y = f.y
       left join draft_projection p on p.y = d.y
       left join {wacc} w on w.y = f.y),
draft_priced as (
  select *,
    final / nullif(case when 1 + g <> 0 or n >= 0 then pow(1 + g, n) end, 0) as pv,
    terminal / nullif(case when 1 + r <> 0 or n >= 0 then pow(1 + r, n) end, 0) as pv_terminal
  from drafted)"""


# Comparisons that depend on the case of a text, and the same in any case.
_CASES = (
    (re.compile(" like "), " ilike "),
    (re.compile(r"\bsub = ('[^']*')"), r"lower(sub) = lower(\1)"),
)


def in_any_case(statement: str) -> str:
    """The statement as it is under a collation in which case does not count."""
    for pattern, instead in _CASES:
        statement = pattern.sub(instead, statement)
    return statement


def oracle_sql(ledger: str = LEDGER) -> dict[str, str]:
    """The statement for each registered report, by name.

    ``ledger`` defines ``account_class, sub_type, account, posting, payment, entry``; it is empty
    where those are tables.
    """
    base = _chain(ledger)
    legacy = _chain(ledger, _legacy_figures())
    exact_projection = _chain(ledger, _projection("cast(f.fcf as double)", "wacc"))
    legacy_projection = _chain(
        ledger, _legacy_figures(), _projection(f"({number('f.fcf')})", "legacy_wacc")
    )
    money = "cast({} as double) as {}".format

    fcf_columns = (
        f"y as year, {money('revenue', 'total_revenue')}, {money('expense', 'total_expense')}, "
        f"{money('ebt', 'ebt')}, {money('fcf', 'free_cash_flow')}"
    )
    weights = (
        "y as year, ev as equity_weight, dv as debt_weight, "
        f"{money('firm_value', 'firm_value')}"
    )
    pooled = """
      select c.y, r.net as revenue, x.net as expense, r.net - x.net + c.da + c.wc - c.capex as fcf
      from component c,
           (select sum(credit) - sum(debit) as net from classed where class = 4) r,
           (select sum(debit) - sum(credit) as net from classed where class = 5) x"""
    matrix = "from debt_paid d cross join interest i"
    matrix_columns = (
        f"d.y as debt_year, i.y as interest_year, {money('d.amount', 'total_debt')}, "
        f"{money('i.amount', 'total_interest')}"
    )
    text_ratio = f"({number('i.amount')}) / nullif({number('d.amount')}, 0)"
    last_revenue = "(select {} from revenue where y = (select max(y) from revenue))".format
    mean = f"(select max(y) from revenue) as year, {money(last_revenue('gross'), 'revenue')}"

    def clamp(rate: str) -> str:
        return (
            f"case when {rate} is not null "
            f"then cast(greatest(least(round({rate}, 1), 99.9), -99.9) + 0.0 as double) end"
        )

    def draft(cash_flow: str) -> str:
        return (
            f"{base} select f.y as year, {cash_flow} as free_cash_flow from fcf f "
            f"where f.y = (select max(y) from fcf) union all "
            f"select f.y + 1, {cash_flow} * (1 + m.g) from fcf f "
            f"left join (select {clamp('g')} as g from mean_net) m on m.g = f.y "
            f"where f.y < {HORIZON}"
        )

    def projections(chain: str, suffix: str = "") -> dict[str, str]:
        return {
            f"{suffix}fcf_projection": f"{chain} select y as year, final as fcf_final, "
            "projected as fcf_projected from projection",
            f"{suffix}pv_fcf": f"{chain} select y as year, final as fcf_final, g as growth, "
            f"{digits('pv')} as present_value_fcf from priced",
            f"{suffix}terminal_value": f"{chain} select y as year, projected as fcf_projected, "
            f"g as growth, r as wacc, {digits('terminal')} as terminal_value from priced",
            f"{suffix}pv_terminal_value": f"{chain} select y as year, r as wacc, "
            f"{digits('terminal')} as terminal_value, "
            f"{digits('pv_terminal')} as present_value_terminal_value from priced",
        }

    report_values = (
        f"g as growth, {digits('pv')} as present_value_fcf, "
        f"{digits('terminal')} as terminal_value, "
        f"{digits('pv_terminal')} as present_value_terminal_value"
    )
    rated = """
      (select f.y, cast(f.fcf as double) as fcf, w.r, m.g
       from complete_fcf f join wacc_textbook w on w.y = f.y cross join mean_net m)"""
    flows = " + ".join(
        f"fcf * pow(1 + g, {k}) / nullif(pow(1 + r, {k}), 0)" for k in (1, 2, 3)
    )
    discounted = f"fcf / nullif(pow(1 + r, y - {BASE_YEAR} + 1), 0)"
    fair_terminal = "fcf * pow(1 + g, 3) * (1 + g) / nullif(r - g, 0) / nullif(pow(1 + r, 3), 0)"

    draft_chain = _chain(
        ledger, _draft_valuation("cast(f.fcf as double)", clamp("g"), "wacc_collapsed")
    )
    legacy_draft_chain = _chain(
        ledger,
        _legacy_figures(),
        _draft_valuation(f"({number('f.fcf')})", clamp("g"), "legacy_wacc_collapsed"),
    )
    draft_values = report_values.replace("g as growth", "g as mean_growth")

    return {
        "total_revenue": f"{base} select {money('sum(credit) - sum(debit)', 'total_revenue')} "
        "from classed where class = 4",
        "total_expense": f"{base} select {money('sum(debit) - sum(credit)', 'total_expense')} "
        "from classed where class = 5",
        "annual_revenue": f"{base} select y as year, {money('net', 'total_revenue')} from revenue",
        "annual_expense": f"{base} select y as year, {money('net', 'total_expense')} from expense",
        "fcf_components": f"{base} select y as year, {money('da', 'depreciation_amortization')}, "
        f"{money('wc', 'change_in_working_capital')}, {money('capex', 'capex')} from component",
        "fcf_pooled_ebt": f"{base} select y as year, {money('revenue', 'total_revenue')}, "
        f"{money('expense', 'total_expense')}, {money('fcf', 'free_cash_flow')} from ({pooled})",
        "fcf_pooled_formatted": f"{base} select y as year, "
        f"'Rp. ' || {text('revenue')} as total_revenue, "
        f"'Rp. ' || {text('expense')} as total_expense, "
        f"'Rp. ' || {text('fcf')} as free_cash_flow from ({pooled})",
        "fcf_annual": f"{base} select {fcf_columns} from complete_fcf",
        "fcf_annual_left": f"{base} select {fcf_columns} from fcf",
        "fcf_annual_formatted": f"{base} select y as year, "
        f"'Rp. ' || {text('revenue')} as total_revenue, "
        f"'Rp. ' || {text('expense')} as total_expense, {text('ebt')} as ebt, "
        f"'Rp. ' || {text('fcf')} as free_cash_flow from complete_fcf",
        "debt_by_payment_year": f"{base} select y as year, name as account_name, "
        f"{money('amount', 'total_debt')} from debt_paid",
        "debt_by_account_year": f"{base} select y as year, name as account_name, "
        f"{money('amount', 'total_debt')} from debt_opened",
        "debt_single_account": f"{base} select p.y as year, min(a.name) as account_name, "
        f"{money('sum(p.amount)', 'total_debt')} from payment p join account a "
        f"on a.id = p.account_id where a.id = {SINGLE_ACCOUNT} group by p.y",
        "interest_by_entry_year": f"{base} select y as year, "
        f"{money('amount', 'total_interest')} from interest",
        "debt_interest_matrix": f"{base} select d.name as account_name, {matrix_columns} {matrix}",
        "debt_interest_matrix_formatted": f"{base} select d.name as account_name, "
        f"d.y as debt_year, i.y as interest_year, {text('d.amount')} as total_debt, "
        f"{text('i.amount')} as total_interest {matrix}",
        "cost_of_debt_cross": f"{base} select {matrix_columns}, cast(i.amount as double) "
        f"/ nullif(cast(d.amount as double), 0) as cost_of_debt {matrix}",
        "cost_of_debt_by_interest_year": f"{base} select * exclude (nth) from (select "
        f"{matrix_columns}, cast(i.amount as double) / nullif(cast(d.amount as double), 0) "
        "as cost_of_debt, row_number() over (partition by i.y order by d.y nulls first) as nth "
        f"{matrix}) where nth = 1",
        "cost_of_debt": f"{base} select y as debt_year, y as interest_year, "
        f"{money('debt', 'total_debt')}, {money('interest', 'total_interest')}, "
        "ratio as cost_of_debt from kd",
        "equity_by_year": f"{base} select y as year, {money('net', 'total_equity')} from equity",
        "equity_formatted": f"{base} select y as year, {text('net')} as total_equity from equity",
        "firm_value": f"{base} select y as year, {money('firm_value', 'firm_value')} from firm",
        "equity_weight": f"{base} select y as year, ev as equity_weight from weight",
        "debt_weight": f"{base} select y as year, dv as debt_weight from weight",
        "capital_structure": f"{base} select {weights} from weight",
        "capital_structure_formatted": f"{base} select y as year, {text('ev')} as equity_weight, "
        f"{text('dv')} as debt_weight, {money('firm_value', 'firm_value')} from weight",
        "ebt": f"{base} select y as year, {money('amount', 'ebt')} from ebt",
        "tax_gap": f"{base} select y as year, {money('gap', 'tax_gap')} from rate where ebt <> 0",
        "tax_gap_formatted": f"{base} select y as year, {text('gap')} as tax_gap "
        "from rate where ebt <> 0",
        "wacc": f"{base} select y as year, r as wacc from wacc",
        "annual_gross_revenue": f"{base} select y as year, {money('gross', 'total_revenue')} "
        "from revenue",
        "revenue_growth": f"{base} select y as year, {money('revenue', 'total_revenue')}, "
        f"{money('before', 'previous_revenue')}, g as growth from gross_growth",
        "net_revenue_growth": f"{base} select y as year, {money('revenue', 'total_revenue')}, "
        f"{money('before', 'previous_revenue')}, g as growth from net_growth",
        "mean_growth_left": f"{base} select {mean}, "
        f"(select {text('avg(g)')} from gross_growth) as mean_growth",
        "mean_growth_inner": f"{base} select {mean}, "
        f"(select {digits('avg(g)')} from gross_growth) as mean_growth",
        "mean_growth_1dp": f"{base} select (select max(y) from revenue) as year, "
        f"{text(last_revenue('net'))} as revenue, {clamp('g')} as mean_growth from mean_net",
        "annual_growth_1dp": f"{base} select y as year, {money('revenue', 'revenue')}, "
        "g as growth from growth",
        "annual_growth_formatted": f"{base} select y as year, {text('revenue')} as revenue, "
        "g as growth from growth",
        "fcf_projection_draft": draft("cast(f.fcf as double)"),
        "legacy_fcf_projection_draft": draft(f"({number('f.fcf')})"),
        **projections(exact_projection),
        "valuation_report": f"{exact_projection} select y as year, {money('revenue', 'revenue')}, "
        f"{money('expense', 'total_expense')}, {money('ebt', 'ebt')}, "
        f"{money('fcf', 'free_cash_flow')}, {report_values} from priced",
        "legacy_cost_of_debt": f"{legacy} select y as debt_year, y as interest_year, "
        f"debt as total_debt, interest as total_interest, {text('ratio')} as cost_of_debt "
        "from legacy_kd_ratio",
        "legacy_cost_of_debt_cross": f"{base} select d.y as debt_year, i.y as interest_year, "
        f"{text('d.amount')} as total_debt, {text('i.amount')} as total_interest, "
        f"{text(text_ratio)} as cost_of_debt {matrix}",
        "legacy_wacc": f"{legacy} select y as year, r + 0.0 as wacc from legacy_wacc",
        **projections(legacy_projection, "legacy_"),
        "legacy_valuation": f"{legacy_projection} select y as year, {text('revenue')} as revenue, "
        f"{text('expense')} as total_expense, {text('ebt')} as ebt, "
        f"{text('fcf')} as free_cash_flow, {report_values} from priced",
        "wacc_by_interest_year": f"{base} select y as year, interest_year, r as wacc "
        "from wacc_collapsed",
        "legacy_wacc_by_interest_year": f"{legacy} select y as year, interest_year, "
        "r + 0.0 as wacc from legacy_wacc_collapsed",
        "valuation_draft": f"{draft_chain} select y as year, {money('revenue', 'revenue')}, "
        f"{money('expense', 'total_expense')}, {money('ebt', 'ebt')}, "
        f"{money('fcf', 'free_cash_flow')}, {draft_values} from draft_priced",
        "legacy_valuation_draft": f"{legacy_draft_chain} select y as year, "
        f"{text('revenue')} as revenue, {text('expense')} as total_expense, "
        f"{text('ebt')} as ebt, {text('fcf')} as free_cash_flow, {draft_values} "
        "from draft_priced",
        "tax_rate_ratio": f"{base} select y as year, ratio as tax_rate from rate",
        "wacc_textbook": f"{base} select y as year, r as wacc from wacc_textbook",
        "equity_from_balance": f"{base} select y as year, {money('assets', 'total_assets')}, "
        f"{money('debts', 'total_liabilities')}, {money('assets - debts', 'equity')} from ("
        "select y, sum(if(class = 1, debit - credit, 0)) as assets, "
        "sum(if(class = 2, credit - debit, 0)) as debts "
        "from classed where class in (1, 2) group by y)",
        "pv_fcf_wacc": f"{base} select y as year, fcf as free_cash_flow, r as wacc, "
        f"{digits(discounted)} as present_value_fcf from {rated}",
        "terminal_value_mean_g": f"{base} select y as year, fcf as free_cash_flow, "
        f"{digits('g')} as mean_growth, r as wacc, "
        f"{digits('fcf * (1 + g) / nullif(r - g, 0)')} as terminal_value from {rated}",
        "fair_value": f"{base} select y as year, {digits(flows)} as present_value_fcf, "
        f"{digits(fair_terminal)} as present_value_terminal, "
        f"{digits(f'{flows} + {fair_terminal}')} as fair_value from {rated}",
    }
