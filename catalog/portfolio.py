"""Portfolio reports (family E, fixed part)."""

from __future__ import annotations

from catalog import over, query
from catalog.common import BAND, CHARGES, RATE, TYPED, accounts, raw_accounts, stable, views
from catalog.rules import SCORE, STATUS
from keepwell import domain
from keepwell.operators import portfolio, profiling
from keepwell.plans.training import assign_split


@query("e07_portfolio_kpis", over("accounts", TYPED) + f"""
select 1 as position, 'Total Customers' as metric, count(*)::double as value from ta
union all select 2, 'Overall Churn Rate', round({RATE}, 9) from ta
union all select 3, 'Average Monthly Charges', round({CHARGES}, 9) from ta
union all select 4, 'Average Tenure', round(avg(tenure), 9) from ta
union all select 5, 'Churned Customers', coalesce(sum(label), 0)::double from ta""")
def e07(spark, sf):
    return stable(portfolio.portfolio_kpis(accounts(spark, sf)), "value")


def _by(column: str, source: str = "ta") -> str:
    return f"""select {column}, count(customerID) as customers, round({RATE}, 9) as churn_rate from {source}
      where {column} is not null and label is not null group by 1"""


@query("e08_churn_by", over("accounts", TYPED) + _by("TechSupport"))
def e08(spark, sf):
    return stable(portfolio.churn_by(accounts(spark, sf), "TechSupport"), "churn_rate")


@query("e09_churn_by_contract", over("accounts", TYPED) + f"""
select *, case Contract when 'Month-to-month' then 1 when 'One year' then 2 when 'Two year' then 3 end as rank
from ({_by('Contract')})""")
def e09(spark, sf):
    return stable(portfolio.churn_by_contract(accounts(spark, sf)), "churn_rate")


@query("e10_churn_by_payment", over("accounts", TYPED) + _by("PaymentMethod"))
def e10(spark, sf):
    return stable(portfolio.churn_by_payment(accounts(spark, sf)), "churn_rate")


@query("e11_churn_by_internet", over("accounts", TYPED) + _by("InternetService"))
def e11(spark, sf):
    return stable(portfolio.churn_by_internet(accounts(spark, sf)), "churn_rate")


BANDED = f"banded as (select *, {BAND} as segment from ta)"


@query("e12_segment_summary", over("accounts", TYPED, BANDED) + f"""
select segment, customers as customer_count, churn_rate, case segment when '0–12 months' then 1
  when '13–24 months' then 2 when '25–48 months' then 3 else 4 end as rank from ({_by('segment', 'banded')})""")
def e12(spark, sf):
    return stable(portfolio.segment_summary(accounts(spark, sf)), "churn_rate")


@query("e13_churn_breakdowns", over("accounts", TYPED, BANDED) + " union all ".join(
    f"select '{name}' as dimension, {column} as value, customers, churn_rate from ({_by(column, 'banded')})"
    for name, column in [("Contract", "Contract"), ("PaymentMethod", "PaymentMethod"),
                         ("InternetService", "InternetService"), ("Tenure Band", "segment")]))
def e13(spark, sf):
    return stable(portfolio.churn_breakdowns(accounts(spark, sf)), "churn_rate")


@query("e18_status_distribution", over("customers") + f"""
select {STATUS} as value, count(*) as customers, count(*)::double / sum(count(*)) over () as share
from customers group by 1""")
def e18(spark, sf):
    return profiling.distribution(portfolio.with_health(views.customers(spark, sf)), "status")


@query("e25_executive_metrics", over("scored") + f"""
select 1 as position, 'Total Customers' as metric, count(*)::double as value from scored
union all select 2, 'Overall Churn Rate (%)', format('{{:.2f}}', {RATE})::double from scored
union all select 3, 'Average Monthly Charges', format('{{:.2f}}', {CHARGES})::double from scored
union all select 4, 'Average Tenure (Months)', format('{{:.2f}}', avg(tenure))::double from scored
union all select 5, 'High / Critical Risk Customers', count(*) filter (probability >= 33e-2)::double from scored""")
def e25(spark, sf):
    scored = views.scored(spark, sf)
    return portfolio.executive_metrics(scored, scored)


BUCKET = "cast('0x' || substr(md5(concat(customerID, '#42')), 1, 8) as bigint)"


@query("e26_class_balance", over("accounts", TYPED) + f"""
select case when {BUCKET} % 100 < 20 then 'test' else 'train' end as split, count(*) as rows, 19 as features,
       count(*) filter (label = 1) as positives, count(*) filter (label = 0) as negatives,
       round({RATE}, 9) as churn_rate
from ta where label is not null group by 1""")
def e26(spark, sf):
    labelled = assign_split(accounts(spark, sf).dropna(subset=["label"]))
    features = [*domain.NUMERIC_FEATURES, *domain.CATEGORICAL_FEATURES]
    return stable(portfolio.class_balance(labelled, features, "split"), "churn_rate")


@query("e27_cs_kpis", over("customers") + f"""
select 1 as position, 'Customers' as metric, count(*)::double as value from customers
union all select 2, 'Average Usage', round(avg(usage), 9) from customers
union all select 3, 'Average Tickets', round(avg(tickets), 9) from customers
union all select 4, 'Average NPS', round(avg(nps), 9) from customers
union all select 5, 'Average Health', round(avg({SCORE}), 9) from customers
union all select 6, 'Open Tickets', sum(tickets)::double from customers""")
def e27(spark, sf):
    return stable(portfolio.cs_kpis(portfolio.with_health(views.customers(spark, sf))), "value")


@query("e27_cs_kpis_fallback", over("accounts", TYPED) + """
select 1 as position, 'Customers' as metric, count(*)::double as value from ta
union all select 2, 'Average Monthly Charges', round(avg(MonthlyCharges), 9) from ta
union all select 3, 'Average Tenure', round(avg(tenure), 9) from ta
union all select 4, 'Churn Rate', round(count(*) filter (lower(trim(Churn)) = 'yes')::double * 1e2 / count(*), 9)
  from ta""")
def e27_fallback(spark, sf):
    found = {"revenue": "MonthlyCharges", "tenure": "tenure", "churn": "Churn"}
    return stable(portfolio.cs_kpis(raw_accounts(spark, sf), found), "value")
