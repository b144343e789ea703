"""Profile cards, comparisons and rankings (family G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import over, query
from catalog.common import TIER, views
from catalog.rules import SCORE, STATUS, _case
from catalog.select import IDS, requested
from keepwell import domain
from keepwell.operators import comparison, portfolio

HEALTH = f"""h as (select *, {SCORE} as health_score, {STATUS} as status,
  {_case(f'({STATUS})', domain.HEALTH_TEXTS)} as recommendation from customers)"""


@query("g01_customers_with_health", over("customers", HEALTH) + "select * from h")
def g01(spark, sf):
    return portfolio.with_health(views.customers(spark, sf))


@query("g07_health_ranking", over("customers", HEALTH) + "select * from h")
def g07(spark, sf):
    return portfolio.health_ranking(views.customers(spark, sf))


# every account paired with the next one; some with themselves, the last ones with accounts that do not exist
PAIRS = """pairs as (
  select customerID as a, case when k % 50 = 0 then customerID else
    concat('C', lpad(cast(k + 1 as varchar), greatest(8, length(cast(k + 1 as varchar)))::int, '0')) end as b
  from scored)"""
SHOWN = {
    "Tenure": "concat({0}.tenure, ' months')",
    "Monthly Charges": "format('${{:,.2f}}', {0}.MonthlyCharges)",
    "Total Charges": "format('${{:,.2f}}', try_cast(nullif(trim({0}.TotalCharges), '') as double))",
}
BOTH = """matched as (select a, b, x, y from pairs join scored x on x.customerID = a join scored y on y.customerID = b
  where a <> b)"""


def pairs(spark, sf):
    following = (F.col("k") + 1).cast("string")
    other = F.concat(F.lit("C"), F.lpad(following, F.greatest(F.lit(8), F.length(following)), F.lit("0")))
    b = F.when(F.col("k") % 50 == 0, F.col("customerID")).otherwise(other)
    return views.scored(spark, sf, stored=True).select(F.col("customerID").alias("a"), b.alias("b"))


def scored(spark, sf):
    return views.scored(spark, sf, stored=True)


def _shown(label: str, column: str, record: str) -> str:
    text = SHOWN.get(label, "cast({0}." + column + " as varchar)").format(record)
    return f"coalesce({text}, 'Not available')"


SUMMARY = " union all ".join(
    f"select id as requested_id, {i} as position, '{label}' as detail, {_shown(label, c, 's')} as value "
    "from ids join scored s on s.customerID = id"
    for i, (label, c) in enumerate(domain.SUMMARY_FIELDS.items(), start=1))


@query("g02_customer_summary", over("scored", IDS) + SUMMARY)
def g02(spark, sf):
    return comparison.customer_summary(scored(spark, sf), requested(spark, sf))


def _fields() -> list[tuple[str, str, str]]:
    rows = [(label, _shown(label, c, "x"), _shown(label, c, "y")) for label, c in domain.COMPARISON_FIELDS.items()]
    for label, text in [
        ("Predicted Churn Probability", "concat(format('{{:.1f}}', {0}.probability * 100), '%')"),
        ("Risk Tier", TIER.replace("probability", "{0}.probability")),
        ("Intervention Threshold Position",
         "case when {0}.probability >= 33e-2 then 'Above threshold' else 'Below threshold' end"),
    ]:
        rows.append((label, text.format("x"), text.format("y")))
    return rows


COMPARED = " union all ".join(
    f"select a, b, {i} as position, '{label}' as metric, {x} as customer_a, {y} as customer_b from matched"
    for i, (label, x, y) in enumerate(_fields(), start=1))


@query("g03_compare_customers", over("scored", PAIRS, BOTH) + COMPARED)
def g03(spark, sf):
    return comparison.compare_customers(scored(spark, sf), pairs(spark, sf))


DIFFERENT = " , ".join([
    """case when x.tenure is distinct from y.tenure then case when x.tenure < y.tenure
         then 'Customer A has shorter tenure than Customer B.' else 'Customer B has shorter tenure than Customer A.' end
       end""",
    """case when x.MonthlyCharges <> y.MonthlyCharges then concat(case when x.MonthlyCharges > y.MonthlyCharges
         then 'Customer A' else 'Customer B' end, ' has higher monthly charges.') end""",
    *[f"""case when x.{c} is distinct from y.{c} then concat('The customers differ in {label}: Customer A has ',
          coalesce(x.{c}, 'Not available'), ', while Customer B has ', coalesce(y.{c}, 'Not available'), '.') end"""
      for label, c in [("contract", "Contract"), ("internet service", "InternetService"),
                       ("payment method", "PaymentMethod"), ("Tech Support", "TechSupport"),
                       ("Online Security", "OnlineSecurity")]],
    """case when x.probability <> y.probability then concat(case when x.probability > y.probability then 'Customer A'
         else 'Customer B' end, ' has the higher predicted churn probability.') end""",
])


@query("g04_customer_differences", over("scored", PAIRS, BOTH) + f"""
select a, b, unnest(d) as difference, generate_subscripts(d, 1) as position
from (select a, b, list_filter([{DIFFERENT}], lambda t: t is not null) as d from matched)""")
def g04(spark, sf):
    return comparison.customer_differences(scored(spark, sf), pairs(spark, sf))


@query("g05_comparison_takeaway", over("scored", PAIRS, BOTH) + """
select a, b, gap, case
  when x.probability > y.probability then format('Customer A has a predicted churn risk {:.1f} percentage points higher than Customer B.', gap)
  when y.probability > x.probability then format('Customer B has a predicted churn risk {:.1f} percentage points higher than Customer A.', gap)
  else 'Customer A and Customer B have the same predicted churn probability.' end as takeaway
from (select *, abs(x.probability - y.probability) * 100 as gap from matched)""")
def g05(spark, sf):
    return comparison.comparison_takeaway(scored(spark, sf), pairs(spark, sf))


@query("g06_pair_status", over("scored", PAIRS) + """
select a, b, case when a = b then 'same customer' when y.customerID is null then 'not found' else 'compared' end
  as status from pairs left join scored y on y.customerID = b""")
def g06(spark, sf):
    return comparison.pair_status(scored(spark, sf), pairs(spark, sf))
