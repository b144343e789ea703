"""Scalar functions and business rules (family D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import over, query
from catalog.common import BAND, TIER, TYPED, accounts, raw_accounts, stable, table, views
from keepwell import domain
from keepwell.functions import display, rules
from keepwell.functions.values import clamp, is_number, strip
from keepwell.operators import comparison

SCORE = "usage * 5e-1 + nps * 5 - tickets * 2"
STATUS = f"case when {SCORE} >= 80 then 'Healthy' when {SCORE} >= 60 then 'At Risk' else 'Critical' end"


def _case(column: str, texts: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in texts.items()) + " end"


@query("d01_health_score", over("customers") + f"select id, {SCORE} as health_score from customers")
def d01(spark, sf):
    return views.customers(spark, sf).select("id", rules.health_score("usage", "nps", "tickets").alias("health_score"))


@query("d02_health_status", over("customers") + f"select id, {STATUS} as status from customers")
def d02(spark, sf):
    return views.customers(spark, sf).select(
        "id", rules.health_status(rules.health_score("usage", "nps", "tickets")).alias("status"))


@query("d03_health_recommendation", over("customers") + f"""
select id, {_case(f'({STATUS})', domain.HEALTH_TEXTS)} as recommendation from customers""")
def d03(spark, sf):
    status = rules.health_status(rules.health_score("usage", "nps", "tickets"))
    return views.customers(spark, sf).select("id", rules.health_recommendation(status).alias("recommendation"))


LEVEL = "case when usage >= 70 then 'High' when usage >= 40 then 'Medium' else 'Low' end"


@query("d04_renewal_risk", over("customers") + f"""
select id, {LEVEL} as risk_level, {_case(f'({LEVEL})', domain.RENEWAL_TEXTS)} as recommendation from customers""")
def d04(spark, sf):
    return views.customers(spark, sf).withColumn("risk_level", rules.renewal_risk("usage")).select(
        "id", "risk_level", rules.renewal_recommendation("risk_level").alias("recommendation"))


@query("d05_risk_tier", over("scored") + f"select customerID, probability, {TIER} as tier from scored")
def d05(spark, sf):
    return views.scored(spark, sf).select("customerID", "probability", rules.risk_tier("probability").alias("tier"))


ACTIONS = f"""advised as (
  select customerID, tier, list_filter([{_case('tier', domain.TIER_ACTIONS)},
    case when Contract = 'Month-to-month' then '{domain.CONTRACT_ACTION}' end,
    case when TechSupport = 'No' then '{domain.SUPPORT_ACTION}' end,
    case when OnlineSecurity = 'No' then '{domain.SECURITY_ACTION}' end,
    case when PaymentMethod = 'Electronic check' then '{domain.PAYMENT_ACTION}' end,
    case when tenure < 12 then '{domain.TENURE_ACTION}' end], lambda x: x is not null)[1:5] as actions
  from (select *, {TIER} as tier from scored))"""


@query("d06_recommend", over("scored", ACTIONS) + """
select customerID, tier, array_to_string(actions, ' | ') as actions from advised""")
def d06(spark, sf):
    return comparison.recommend(views.scored(spark, sf)).select(
        "customerID", F.col("risk_tier").alias("tier"), F.concat_ws(" | ", "actions").alias("actions"))


@query("d07_explode_actions", over("scored", ACTIONS) + """
select customerID, unnest(actions) as action, generate_subscripts(actions, 1) as number from advised""")
def d07(spark, sf):
    return comparison.explode_actions(comparison.recommend(views.scored(spark, sf)))


@query("d08_tenure_band", over("accounts") + f"select customerID, {BAND} as band from accounts")
def d08(spark, sf):
    return raw_accounts(spark, sf).select("customerID", rules.tenure_band("tenure").alias("band"))


@query("d09_churn_status", over("accounts", TYPED) + """
select customerID, case label when 0 then 'Retained' when 1 then 'Churned' end as status from ta""")
def d09(spark, sf):
    return accounts(spark, sf).select("customerID", rules.churn_status("label").alias("status"))


@query("d10_is_positive", over("accounts") + """
select customerID, coalesce(lower(trim(Churn)) in ('yes', 'true', '1', 'churned', 'cancelled', 'canceled', 'left',
  'exited'), false) as positive, SeniorCitizen = 1 as senior from accounts""")
def d10(spark, sf):
    return raw_accounts(spark, sf).select("customerID", rules.is_positive("Churn").alias("positive"),
                                          rules.is_positive("SeniorCitizen").alias("senior"))


@query("d11_is_positive_older", over("accounts") + """
select customerID, coalesce(lower(trim(Churn)) in ('yes', 'true', '1', 'churned'), false) as positive from accounts""")
def d11(spark, sf):
    return raw_accounts(spark, sf).select(
        "customerID", rules.is_positive("Churn", domain.OLDER_POSITIVE_LABELS).alias("positive"))


@query("d12_text_functions", over("accounts") + """
select customerID, lower(trim(Churn)) as plain, replace(concat('categorical__', PaymentMethod), 'categorical__', '')
         as bare,
       array_to_string(list_transform(string_split(lower(replace(PaymentMethod, '_', ' ')), ' '),
         lambda w: concat(upper(w[1]), w[2:])), ' ') as title,
       regexp_replace(PaymentMethod, '[^A-Za-z]', '', 'g') as letters,
       contains(PaymentMethod, 'check') as has_check
from accounts""")
def d12(spark, sf):
    method = F.col("PaymentMethod")
    return raw_accounts(spark, sf).select(
        "customerID", F.lower(strip("Churn")).alias("plain"),
        display.bare_feature(F.concat(F.lit("categorical__"), method)).alias("bare"),
        display.title_text(method).alias("title"), F.regexp_replace(method, "[^A-Za-z]", "").alias("letters"),
        F.contains(method, F.lit("check")).alias("has_check"))


@query("d13_math_functions", over("scored") + """
select customerID, abs(probability - 5e-1) as distance, probability * 1e2 as percent,
       format('{:.2f}', probability * 1e2)::double as rounded,
       least(greatest(probability * 2 - 5e-1, 0), 1) as clamped,
       round(abs(probability - label) * 1e2, 9) as gap_points
from scored""")
def d13(spark, sf):
    p = F.col("probability")
    return stable(views.scored(spark, sf).select(
        "customerID", F.abs(p - 0.5).alias("distance"), (p * 100.0).alias("percent"),
        display.rounded(p * 100.0, 2).alias("rounded"), clamp(p * 2 - 0.5).alias("clamped"),
        (F.abs(p - F.col("label")) * 100.0).alias("gap_points")), "gap_points")


@query("d14_display_formats", over("accounts", TYPED) + """
select customerID, format('${:,.2f}', total) as money, concat(format('{:.1f}', MonthlyCharges), '%') as pct,
       concat(tenure, ' months') as months, format('{:,.0f}', total) as whole
from ta""")
def d14(spark, sf):
    return accounts(spark, sf).select(
        "customerID", display.fmt_money("TotalCharges").alias("money"), display.fmt_pct("MonthlyCharges").alias("pct"),
        display.fmt_months("tenure").alias("months"), display.fmt_int("TotalCharges").alias("whole"))


@query("d15_driver_text", """
select l_orderkey, l_linenumber, concat(l_returnflag, ' ', l_linestatus, ' ', l_partkey, ' — contributes to ',
  case when l_discount - 5e-2 > 0 then 'higher' else 'lower' end, ' predicted churn risk.') as driver from lineitem""")
def d15(spark, sf):
    feature = F.concat_ws("_", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", display.driver_text(feature, F.col("l_discount") - 0.05).alias("driver"))


@query("d16_is_number", over("accounts", TYPED) + "select customerID, total is not null as numeric from ta")
def d16(spark, sf):
    return raw_accounts(spark, sf).select("customerID", is_number("TotalCharges").alias("numeric"))
