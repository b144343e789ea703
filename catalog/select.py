"""Projections, filters, predicates, sorts and limits (families C and H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import over, query
from catalog.common import TYPED, accounts, raw_accounts, table, views
from catalog.tables import INCOMING_CTE, incoming
from keepwell import domain
from keepwell.functions.rules import threshold_position
from keepwell.functions.values import or_missing
from keepwell.operators import roles, selection


@query("c01_search", over("accounts") + """
select 'regex' as mode, customerID, PaymentMethod from accounts where regexp_matches(lower(PaymentMethod), '^(mail|bank)')
union all select 'literal', customerID, PaymentMethod from accounts where contains(lower(PaymentMethod), '(automatic)')
union all select 'churn', customerID, PaymentMethod from accounts where regexp_matches(lower(Churn), 'yes')""")
def c01(spark, sf):
    frame = raw_accounts(spark, sf)
    found = {
        "regex": selection.search(frame, "PaymentMethod", "^(mail|bank)"),
        "literal": selection.search(frame, "PaymentMethod", "(Automatic)", literal=True),
        "churn": selection.search(frame, "Churn", "YES"),
    }
    parts = [df.select(F.lit(mode).alias("mode"), "customerID", "PaymentMethod") for mode, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("c02_filter_in", over("accounts") + """
select customerID, InternetService from accounts where InternetService in ('DSL', 'No')""")
def c02(spark, sf):
    return selection.filter_in(raw_accounts(spark, sf), "InternetService", ["DSL", "No"]).select(
        "customerID", "InternetService")


@query("c03_distinct_values", over("accounts") + """
select distinct customerID as value from accounts where customerID is not null""")
def c03(spark, sf):
    return selection.distinct_values(raw_accounts(spark, sf), "customerID")


@query("c04_status_options", over("accounts") + "select distinct Churn as value from accounts where Churn is not null")
def c04(spark, sf):
    frame = raw_accounts(spark, sf)
    return selection.distinct_values(frame, selection.status_column(frame.columns, roles.roles_of(frame)))


IDS = """ids as (select concat('C', lpad(n, greatest(8, length(n))::int, '0')) as id
  from (select cast(user_id * 400 + event_id % 3 as varchar) as n from events))"""


def requested(spark, sf):
    number = (F.col("user_id") * 400 + F.col("event_id") % 3).cast("string")
    return table(spark, sf, "events").select(F.concat(
        F.lit("C"), F.lpad(number, F.greatest(F.lit(8), F.length(number)), F.lit("0"))).alias("customerID"))


@query("c05_lookup", over("accounts", IDS) + """
select id as requested_id, Contract, tenure, customerID is not null as found from ids left join accounts
on id = customerID""")
def c05(spark, sf):
    return selection.lookup(raw_accounts(spark, sf), requested(spark, sf)).select(
        "requested_id", "Contract", "tenure", "found")


@query("c06_threshold_position", over("scored") + """
select customerID, case when probability >= 33e-2 then 'Above threshold' else 'Below threshold' end as position
from scored""")
def c06(spark, sf):
    return views.scored(spark, sf).select("customerID", threshold_position("probability").alias("position"))


@query("c07_high_risk", over("scored") + "select customerID, probability from scored where probability >= 33e-2")
def c07(spark, sf):
    return selection.high_risk(views.scored(spark, sf)).select("customerID", "probability")


@query("c07_high_risk_count", over("scored") + """
select count(*) filter (probability >= 33e-2) as high_risk from scored""")
def c07_count(spark, sf):
    return selection.high_risk_count(views.scored(spark, sf))


@query("c08_or_missing", over("accounts", TYPED) + """
select customerID, coalesce(Churn, 'Not available') as churn, coalesce(cast(total as varchar), 'Not available') as total
from ta""")
def c08(spark, sf):
    frame = accounts(spark, sf)
    return frame.select("customerID", or_missing("Churn").alias("churn"), or_missing("TotalCharges").alias("total"))


@query("c09_validate_customers", over("customers", INCOMING_CTE) + """
select trim(name) as name, usage, tickets, nps, renewal_status, concat_ws(', ',
  case when not coalesce(length(trim(name)) > 0, false) then 'name is blank' end,
  case when not coalesce(usage between 0 and 100, false) then 'usage is outside 0-100' end,
  case when not coalesce(tickets >= 0, false) then 'tickets is negative' end,
  case when not coalesce(nps between 0 and 10, false) then 'nps is outside 0-10' end,
  case when not coalesce(renewal_status in ('Likely', 'At Risk', 'Unknown'), false) then 'renewal_status is unknown' end
  ) as reasons from incoming""")
def c09(spark, sf):
    valid, rejected = selection.validate_customers(incoming(spark, sf))
    return valid.withColumn("reasons", F.lit("")).unionByName(
        rejected.withColumn("reasons", F.concat_ws(", ", "reasons")))


# ---- H: sorts, limits, top-k --------------------------------------------------------------------
@query("h01_preview", over("accounts") + """
select customerID, Contract, tenure, (select count(*) from accounts) > 1000 as truncated from accounts
order by tenure, customerID limit 1000""")
def h01(spark, sf):
    frame = raw_accounts(spark, sf).select("customerID", "Contract", "tenure")
    return selection.preview(frame, ["tenure", "customerID"], 1000)


IMPORTANCE = """imp as (select concat(p_brand, ' ', p_partkey) as "Feature",
  p_retailprice / (select max(p_retailprice) from part) as "Importance" from part)"""


def importance(spark, sf):
    part = table(spark, sf, "part")
    top = part.agg(F.max("p_retailprice").alias("top")).scalar()
    return part.select(F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string")).alias("Feature"),
                       (F.col("p_retailprice") / top).alias("Importance"))


@query("h02_top_features_chart", f"""with {IMPORTANCE} select * from imp
order by "Importance" desc, "Feature" limit 10""")
def h02(spark, sf):
    return selection.top_features(importance(spark, sf), 10, ascending=True)


@query("h03_top_features_report", f"""with {IMPORTANCE} select * from imp
order by "Importance" desc, "Feature" limit 20""")
def h03(spark, sf):
    return selection.top_features(importance(spark, sf), 20)


@query("h04_top_drivers", """
with long as (
  select l_orderkey as "customerID", concat(l_returnflag, '_', l_linenumber, '_', l_partkey) as feature,
         l_quantity * (case when l_linestatus = 'O' then -1 else 1 end) as shap from lineitem),
ranked as (
  select *, abs(shap) as impact,
         row_number() over (partition by "customerID" order by abs(shap) desc, feature) as rank from long)
select * from ranked where rank <= 5""")
def h04(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("customerID"),
        F.concat_ws("_", "l_returnflag", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
        .alias("feature"),
        (F.col("l_quantity") * F.when(F.col("l_linestatus") == "O", -1).otherwise(1)).alias("shap"))
    return selection.top_drivers(items, 5)


@query("h05_order_by_domain", over("accounts") + "select Contract, customerID from accounts")
def h05(spark, sf):
    frame = raw_accounts(spark, sf).select("Contract", "customerID")
    return selection.order_by_domain(frame, "Contract", domain.CONTRACT_ORDER, "customerID")
