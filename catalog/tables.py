"""Sources, sinks, cleaning and schema discovery (families A and B)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import over, query
from catalog.common import BAND, RATE, TIER, TYPED, accounts, raw_accounts, stable, table, uploaded, views
from keepwell import domain
from keepwell.functions.rules import parse_label
from keepwell.functions.values import normalize_name, to_number
from keepwell.operators import cleaning, evaluation, portfolio, profiling, roles, selection
from keepwell.session import new_path
from keepwell.sources import customers as store
from keepwell.sources import tables
from keepwell.streaming.ingest import stream_customers, streamed_customers

NAMES = [f.name for f in domain.ACCOUNT_SCHEMA.fields]
NA_LIST = ", ".join(f"'{t}'" for t in domain.NA_TEXTS)


def _as_text(column: str) -> str:
    text = f"cast({column} as varchar)"
    return f"case when {text} not in ({NA_LIST}) then {text} end as {column}"


@query("a01_read_csv", over("accounts") + f"select {', '.join(map(_as_text, NAMES))} from accounts")
def a01(spark, sf):
    path = new_path(spark, "a01") + ".csv"
    tables.write_report(raw_accounts(spark, sf), path)
    return tables.read_table(spark, path)


DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@query("a01_read_csv_line_breaks", f"select {', '.join(map(_as_text, DOCUMENT_COLUMNS))} from documents")
def a01_line_breaks(spark, sf):
    """Whole texts, with their line breaks and quotes, as a value each of a CSV that is split over tasks."""
    path = new_path(spark, "a01-breaks") + ".csv"
    tables.write_report(table(spark, sf, "documents").select(*DOCUMENT_COLUMNS), path)
    return tables.read_table(spark, path)


# order lines as text, some with a value too many or too few
RAGGED = '''select concat_ws(',', cast(l_orderkey as string), cast(l_linenumber as string),
  case when l_partkey % 7 = 0 then concat('"', l_returnflag, '",extra') when l_partkey % 7 = 1 then null
       else concat('"', l_returnflag, ', ""', l_linestatus, '"""') end) as `order,line,flag` from {lineitem}'''


@query("a01_read_csv_quarantine", """
select case when l_partkey % 7 < 2 then 'quarantined' else 'good' end as kind,
  case when l_partkey % 7 >= 2 then concat(l_returnflag, ', "', l_linestatus, '"') end as flag, count(*) as rows
from lineitem group by all""")
def a01_quarantine(spark, sf):
    path = new_path(spark, "a01-ragged")
    # one column, written as it is: its name is the header
    spark.sql(RAGGED, lineitem=table(spark, sf, "lineitem")).write.options(
        header=True, sep="\u0001", quote="\u0000").csv(path)
    good, bad = tables.read_csv_quarantined(spark, path, ["order", "line", "flag"])
    both = good.select(F.lit("good").alias("kind"), "flag").unionByName(
        bad.select(F.lit("quarantined").alias("kind"), F.lit(None).cast("string").alias("flag")))
    return both.groupBy("kind", "flag").agg(F.count("*").alias("rows"))


@query("a02_read_by_extension", """
select f.format, c_mktsegment, count(*) as customers, sum(cast(round(c_acctbal * 1e2) as bigint))::bigint as cents
from customer cross join (values ('json'), ('orc'), ('parquet')) f(format) group by all""")
def a02(spark, sf):
    parts = []
    for extension in ("JSON", "orc", "Parquet"):
        path = new_path(spark, "a02") + "." + extension
        table(spark, sf, "customer").write.format(extension.lower()).save(path)
        part = tables.read_table(spark, path).select("c_mktsegment", "c_acctbal")
        parts.append(part.withColumn("format", F.lit(extension.lower())))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("format", "c_mktsegment").agg(
        F.count("*").alias("customers"), F.sum(F.rint(F.col("c_acctbal") * 100).cast("long")).alias("cents"))


@query("a03_require_nonempty", "select count(*) as customers from customer")
def a03(spark, sf):
    return tables.require_nonempty(table(spark, sf, "customer")).agg(F.count("*").alias("customers"))


@query("a05_require_columns", over("accounts") + f"select {', '.join(domain.ANALYTICS_COLUMNS)} from accounts")
def a05(spark, sf):
    return cleaning.require_columns(raw_accounts(spark, sf), domain.ANALYTICS_COLUMNS).select(
        *domain.ANALYTICS_COLUMNS)


@query("a06_write_cleaned", over("accounts", TYPED) + """
select customerID, Contract, trim(Churn) as Churn, tenure::double as tenure, MonthlyCharges, total as TotalCharges
from ta where regexp_matches(lower(Contract), 'month|two')""")
def a06(spark, sf):
    frame = cleaning.clean_frame(uploaded(spark, sf))
    path = new_path(spark, "a06") + ".csv"
    tables.write_report(selection.search(frame, "Contract", "month|two"), path)
    back = tables.read_table(spark, path)
    numbers = [to_number(c).alias(c) for c in ("tenure", "MonthlyCharges", "TotalCharges")]
    return back.select("customerID", "Contract", "Churn", *numbers)


TIERS = f"""tiers as (select {TIER} as tier, count(*) as customers, avg(probability) * 100 as p, avg(label) * 100 as r
  from scored where label is not null group by 1),
every as (select * from (values ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), ('CRITICAL', 4)) t(tier, rank))"""


@query("a07_write_report", over("scored", TIERS) + """
select e.tier, customers::double as customers, round(p, 9) as average_probability, round(r, 9) as actual_churn_rate
from every e left join tiers using (tier)""")
def a07(spark, sf):
    path = new_path(spark, "a07") + ".csv"
    tables.write_report(evaluation.tier_summary(views.scored(spark, sf)).drop("rank"), path, single_file=True)
    back = tables.read_table(spark, path)
    back = back.select("tier", *[to_number(c).alias(c) for c in back.columns if c != "tier"])
    return stable(back, "average_probability", "actual_churn_rate")


@query("a08_read_importance", """
select concat(p_name, '_', p_partkey) as Feature, p_retailprice as Importance from part where p_size % 7 <> 0""")
def a08(spark, sf):
    part = table(spark, sf, "part").select(
        F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("Feature"),
        F.when(F.col("p_size") % 7 == 0, F.lit("not known")).otherwise(F.col("p_retailprice").cast("string"))
        .alias("Importance"))
    path = new_path(spark, "a08") + ".csv"
    tables.write_report(part, path)
    return tables.read_importance(spark, path)


@query("a10_load_customers", over("customers") + "select id, name, usage, tickets, nps, renewal_status from customers")
def a10(spark, sf):
    path = new_path(spark, "a10")
    store.save_customers(views.customers(spark, sf), path)
    return store.load_customers(spark, path)


# customer records as they might arrive, a good part of them broken in one way or another
INCOMING = """
select case when nps = 6 then '  ' else name end as name, case when nps = 10 then usage + 101 else usage end as usage,
       case when nps = 9 then -1 else tickets end as tickets, case when nps = 8 then 11 else nps end as nps,
       case when nps = 7 then 'Maybe' else renewal_status end as renewal_status
from {customers}"""
INCOMING_CTE = "incoming as (" + INCOMING.format(customers="customers") + ")"
VALID = """length(trim(name)) > 0 and usage between 0 and 100 and tickets >= 0 and nps between 0 and 10
  and renewal_status in ('Likely', 'At Risk', 'Unknown')"""


def incoming(spark, sf) -> DataFrame:
    return spark.sql(INCOMING, customers=views.customers(spark, sf))


@query("a11_append_customers", over("customers", INCOMING_CTE) + f"""
select name, usage, tickets, nps, renewal_status, 'stored' as origin from customers
union all select trim(name), usage, tickets, nps, renewal_status, 'appended' from incoming where {VALID}""")
def a11(spark, sf):
    path = new_path(spark, "a11")
    store.save_customers(views.customers(spark, sf), path)
    first = store.next_id(spark, path)
    store.append_customers(incoming(spark, sf), path)
    origin = F.when(F.col("id") < first, F.lit("stored")).otherwise(F.lit("appended"))
    return store.load_customers(spark, path).withColumn("origin", origin).drop("id")


@query("a12_stream_customers", over("customers", INCOMING_CTE) + f"""
select trim(name) as name, usage, tickets, nps, renewal_status,
       case when coalesce({VALID}, false) then 'accepted' else 'rejected' end as outcome from incoming""")
def a12(spark, sf):
    base = new_path(spark, "a12")
    incoming(spark, sf).write.json(f"{base}/in")
    stream_customers(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    accepted, rejected = streamed_customers(spark, f"{base}/out")
    return accepted.drop("id").withColumn("outcome", F.lit("accepted")).unionByName(
        rejected.drop("reasons").withColumn("outcome", F.lit("rejected")))


@query("a12_stream_then_load", over("customers", INCOMING_CTE) + f"""
select name, usage, tickets, nps, renewal_status, 'stored' as origin, usage * 5e-1 + nps * 5 - tickets * 2 as health_score,
  true as one_id from customers
union all select trim(name), usage, tickets, nps, renewal_status, 'streamed', usage * 5e-1 + nps * 5 - tickets * 2, true
from incoming where {VALID}""")
def a12_then_load(spark, sf):
    """Streamed records are customers like others: they have ids of their own, and health scores. A replay adds nothing."""
    base = new_path(spark, "a12-store")
    path = f"{base}/store"
    store.save_customers(views.customers(spark, sf), path)
    first = store.next_id(spark, path)
    incoming(spark, sf).write.json(f"{base}/in")
    for checkpoint in ("checkpoint", "checkpoint"):
        stream_customers(spark, f"{base}/in", path, f"{base}/{checkpoint}").awaitTermination()
    customers = portfolio.with_health(store.load_customers(spark, path))
    taken = customers.groupBy("id").agg(F.count("*").alias("n"))
    return customers.join(taken, "id").select(
        "name", "usage", "tickets", "nps", "renewal_status",
        F.when(F.col("id") < first, F.lit("stored")).otherwise(F.lit("streamed")).alias("origin"), "health_score",
        (F.col("n") == 1).alias("one_id"))


@query("a13_policy_with_observed_rates", over("scored", TIERS) + """
select e.tier, b.lower, b.upper, b.probability_range, customers, round(r, 9) as actual_churn_rate
from every e join (values ('LOW', 0e0, 15e-2, '< 15%'), ('MEDIUM', 15e-2, 33e-2, '15%–33%'),
  ('HIGH', 33e-2, 6e-1, '33%–60%'), ('CRITICAL', 6e-1, 1e0, '>= 60%')) b(tier, lower, upper, probability_range)
  using (tier) left join tiers using (tier)""")
def a13(spark, sf):
    observed = evaluation.tier_summary(views.scored(spark, sf)).select("tier", "customers", "actual_churn_rate")
    return stable(tables.policy_table(spark).join(observed, "tier", "left"), "actual_churn_rate")


# ---- B: cleaning and schema discovery -----------------------------------------------------------
@query("b01_trim_column_names", over("accounts") + """
select customerID, Contract, PaymentMethod as Contract_2, trim(Churn) as Churn from accounts""")
def b01(spark, sf):
    padded = raw_accounts(spark, sf).select(
        F.col("customerID").alias(" customerID "), F.col("Contract").alias("Contract "),
        F.col("PaymentMethod").alias("  Contract"), F.col("Churn").alias("Churn\t"))
    return cleaning.clean_frame(padded)


@query("b02_to_number", over("accounts", TYPED) + "select customerID, total as number from ta")
def b02(spark, sf):
    return raw_accounts(spark, sf).select("customerID", to_number("TotalCharges").alias("number"))


# line items as an uploaded text table: one column mostly numeric, one not quite, blanks and near-numbers
TEXT_ITEMS = """
select cast(l_orderkey as string) as order_key, case when l_linenumber = 1 then ' ' else cast(l_quantity as string) end
         as quantity,
       case when l_linenumber <= 2 then '12d' else concat(' ', cast(l_extendedprice as string), ' ') end as price,
       case when l_linenumber = 3 then 'nan' else l_returnflag end as flag,
       case when l_returnflag = 'R' then null else concat(l_linestatus, ' ') end as status
from {lineitem}"""
TEXT_CTE = "with items as (" + TEXT_ITEMS.format(lineitem="lineitem") + ")\n"
PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def text_items(spark, sf) -> DataFrame:
    return spark.sql(TEXT_ITEMS, lineitem=table(spark, sf, "lineitem"))


RATIOS = " union all ".join(
    f"select {i} as position, '{c}' as \"column\", count(*) as rows, "
    f"count(*) filter (regexp_matches(trim({c}), '{PATTERN}')) as numeric from items"
    for i, c in enumerate(["order_key", "quantity", "price", "flag", "status"]))


@query("b03_numeric_ratios", TEXT_CTE + f"""
select *, numeric::double / rows as ratio, numeric::double / rows >= 8e-1 as promoted from ({RATIOS})""")
def b03_ratios(spark, sf):
    return cleaning.numeric_ratios(text_items(spark, sf))


@query("b03_clean_frame", TEXT_CTE + """
select order_key::double as order_key, try_cast(nullif(trim(quantity), '') as double) as quantity, trim(price) as price,
       trim(flag) as flag, trim(status) as status from items""")
def b03_clean(spark, sf):
    return cleaning.clean_frame(text_items(spark, sf))


@query("b04_column_kinds", TEXT_CTE + f"""
select "column", case when numeric::double / rows >= 8e-1 then 'numeric' else 'categorical' end as kind
from ({RATIOS})""")
def b04(spark, sf):
    kinds = cleaning.column_kinds(cleaning.clean_frame(text_items(spark, sf)))
    return spark.createDataFrame(list(kinds.items()), "column string, kind string")


@query("b05_normalize_name", """
select p_partkey, regexp_replace(lower(concat(p_brand, ' ', p_name)), '[^a-z0-9]', '', 'g') as name from part""")
def b05(spark, sf):
    return table(spark, sf, "part").select("p_partkey", normalize_name(F.concat_ws(" ", "p_brand", "p_name")).alias(
        "name"))


@query("b06_normalize_name_strict", """
select p_partkey, replace(replace(replace(lower(trim(concat(' ', p_brand, '-', p_name, '_'))), ' ', ''), '-', ''),
  '_', '') as name from part""")
def b06(spark, sf):
    text = F.concat(F.lit(" "), "p_brand", F.lit("-"), "p_name", F.lit("_"))
    return table(spark, sf, "part").select("p_partkey", normalize_name(text, "strict").alias("name"))


# every word of every document as a column heading: a catalogue that grows with the data
HEADINGS_SQL = """words as (
  select cast(doc_id as varchar) as "table", unnest(string_split_regex(text, '[ \\t\\r\\n]+')) as "column",
         generate_subscripts(string_split_regex(text, '[ \\t\\r\\n]+'), 1) - 1 as position from documents)"""


def word_headings(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("table"),
        F.posexplode(F.split("text", "[ \\t\\r\\n]+")).alias("position", "column"))


# line items as columns of uploaded tables (one table per order), with headings as people write them
HEADING_TEXTS = [
    "Customer ID", "client-id", "Account_Id", "Name", "id", "Revenue", "Monthly Charges", "total_charges", " MRR ",
    "Sales 2024", "amount due", "Tenure", "months active", "Customer Age", "Churn?", "is_churned", "Cancelled",
    "left at", "Contract Type", "plan", "Subscription Length", "Package", "product usage", "Logins", "sessions/day",
    "Support Tickets", "cases", "open issues", "NPS", "CSAT score", "rating", "Region", "Notes", "???", "carrier", "zip",
]
UPLOADS_SQL = f"""select cast(l_orderkey as string) as {{q}}table{{q}}, cast(l_linenumber as bigint) as position,
  case l_partkey % {len(HEADING_TEXTS)} {' '.join(f"when {i} then '{t}'" for i, t in enumerate(HEADING_TEXTS))} end
  as {{q}}column{{q}} from """
UPLOADS_CTE = "words as (" + UPLOADS_SQL.format(q='"') + "lineitem)"


def upload_headings(spark, sf) -> DataFrame:
    return spark.sql(UPLOADS_SQL.format(q="`") + "{lineitem}", lineitem=table(spark, sf, "lineitem"))


def _alias_values(aliases: dict, plain) -> str:
    rows = sorted({(role, plain(a)) for role, texts in aliases.items() for a in texts})
    return "(values " + ", ".join(f"('{r}', '{a}')" for r, a in rows) + ") a(role, alias)"


FUZZY = _alias_values(domain.ROLE_ALIASES, lambda a: "".join(c for c in a if c.isalnum()))
EXACT = _alias_values(domain.EXACT_ROLE_ALIASES, lambda a: a.replace("_", ""))
FUZZY_SQL = """,
named as (select *, regexp_replace(lower("column"), '[^a-z0-9]', '', 'g') as name from words),
matched as (
  select "table", role, position, "column", max(name = alias) as exact from named
  join FUZZY on name <> '' and (contains(name, alias) or contains(alias, name))
  group by all),
fuzzy as (
  select "table", role, "column", exact from matched
  qualify row_number() over (partition by "table", role order by exact desc, position, "column") = 1)
""".replace("FUZZY", FUZZY)


@query("b07_detect_roles", f"with {UPLOADS_CTE} {FUZZY_SQL} select * from fuzzy")
def b07(spark, sf):
    return roles.detect_roles(upload_headings(spark, sf))


@query("b07_detect_roles_in_texts", f"with {HEADINGS_SQL} {FUZZY_SQL} select * from fuzzy")
def b07_texts(spark, sf):
    return roles.detect_roles(word_headings(spark, sf))


@query("b08_detect_roles_exact", f"""with {UPLOADS_CTE},
named as (select *, replace(replace(replace(lower(trim("column")), ' ', ''), '-', ''), '_', '') as name from words),
once as (select "table", name, max((position, "column")) as last, min(position) as position from named group by all)
select "table", role, last[2] as "column", true as exact from once join {EXACT} on name = alias
qualify row_number() over (partition by "table", role order by once.position, last[2]) = 1""")
def b08(spark, sf):
    return roles.detect_roles(upload_headings(spark, sf), "exact")


@query("b09_kpis_with_overrides", over("accounts", TYPED) + f"""
select 1 as position, 'Customers' as metric, count(distinct customerID)::double as value from ta
union all select 2, 'Average TotalCharges', round(avg(total), 9) from ta
union all select 3, 'Positive/Churn Rate',
  round(count(*) filter (label = 1)::double * 1e2 / count(*), 9) from ta""")
def b09(spark, sf):
    frame = raw_accounts(spark, sf)
    detected = roles.roles_of(frame)
    chosen = roles.resolve_roles(detected, {"revenue": "TotalCharges", "tenure": None, "usage": None, "tickets": None},
                                 frame.columns)
    return stable(profiling.business_kpis(frame, chosen), "value")


@query("b10_role_report", f"""with {UPLOADS_CTE} {FUZZY_SQL},
every as (select "table", role from (select distinct "table" from words)
  cross join (select distinct role from {FUZZY}))
select "table", role, coalesce(f."column", 'Not detected') as "column" from every left join fuzzy f
using ("table", role)""")
def b10(spark, sf):
    headings = upload_headings(spark, sf)
    return roles.role_report(roles.detect_roles(headings), headings)


@query("b11_parse_label", over("accounts", TYPED) + "select customerID, label from ta")
def b11(spark, sf):
    return raw_accounts(spark, sf).select("customerID", parse_label("Churn").alias("label"))


@query("b12_drop_unlabelled", over("accounts", TYPED) + """
select customerID, label from ta where label is not null""")
def b12(spark, sf):
    return cleaning.drop_unlabelled(accounts(spark, sf)).select("customerID", "label")


@query("b13_drop_incomplete", over("accounts", TYPED) + """
select customerID, total as TotalCharges, Churn from ta where total is not null and Churn is not null
  and label is not null""")
def b13(spark, sf):
    return cleaning.drop_incomplete(accounts(spark, sf)).select("customerID", "TotalCharges", "Churn")


@query("b14_split_features", over("accounts", TYPED) + f"""
select {', '.join(n for n in NAMES if n not in ('customerID', 'Churn', 'TotalCharges'))}, total as TotalCharges
from ta""")
def b14(spark, sf):
    return cleaning.split_features(accounts(spark, sf), ["label"])


@query("b15_report_columns", over("accounts", TYPED) + f"""
select band as "Segment", count(*) as "Customer Count", concat(format('{{:.1f}}', {RATE}), '%') as "Churn Rate"
from (select *, {BAND} as band from ta) where band is not null and label is not null group by 1""")
def b15(spark, sf):
    return portfolio.segment_table(accounts(spark, sf))
