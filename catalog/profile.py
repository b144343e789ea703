"""Profiles of any table (family E, adaptive part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import over, query
from catalog.common import TYPED, raw_accounts, stable, table, uploaded, views
from keepwell import domain
from keepwell.operators import profiling, roles
from keepwell.operators.cleaning import clean_frame, typed_accounts

NAMES = [f.name for f in domain.ACCOUNT_SCHEMA.fields]
KINDS = {f.name: f.dataType.simpleString() for f in domain.ACCOUNT_SCHEMA.fields} | {"TotalCharges": "double"}
TYPED_ROLES = {
    "customer_id": "customerID", "revenue": "MonthlyCharges", "tenure": "tenure", "churn": "Churn",
    "contract": "Contract", "usage": None, "tickets": None, "satisfaction": None,
}

CLEAN = TYPED + """,
ca as (select * replace (total as TotalCharges, trim(Churn) as Churn) from ta)"""


def clean_accounts(spark, sf):
    """Accounts as the adaptive pages see them: cleaned, TotalCharges promoted to a number."""
    return clean_frame(uploaded(spark, sf))


def _overview(columns: list[str], source: str) -> str:
    missing = " + ".join(f"count(*) filter ({c} is null)" for c in columns)
    listed = ", ".join(columns)
    return f"""select count(*) as rows, {len(columns)} as columns, {missing} as missing_values,
      count(*) - (select count(*) from (select distinct {listed} from {source})) as duplicate_rows from {source}"""


@query("e01_overview_accounts", over("accounts", CLEAN) + _overview(NAMES, "ca"))
def e01_accounts(spark, sf):
    return profiling.overview(clean_accounts(spark, sf))


ITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                "l_returnflag", "l_linestatus", "l_shipdate"]


@query("e01_overview_lineitem", _overview(ITEM_COLUMNS, "lineitem"))
def e01_lineitem(spark, sf):
    return profiling.overview(table(spark, sf, "lineitem"))


PROFILE = " union all ".join(
    f"select {i} as position, '{c}' as \"column\", '{KINDS[c]}' as type, count(*) filter ({c} is null) as missing, "
    f"count(distinct {c}) as unique from ca" for i, c in enumerate(NAMES, start=1))


@query("e02_profile", over("accounts", CLEAN) + PROFILE)
def e02(spark, sf):
    return profiling.profile(clean_accounts(spark, sf))


@query("e02_profile_customer", " union all ".join(
    f"select {i} as position, '{c}' as \"column\", '{t}' as type, count(*) filter ({c} is null) as missing, "
    f"count(distinct {c}) as unique from customer" for i, (c, t) in enumerate(
        {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
         "c_mktsegment": "string"}.items(), start=1)))
def e02_customer(spark, sf):
    return profiling.profile(table(spark, sf, "customer"))


@query("e02_profile_sketch")
def e02_sketch(spark, sf):
    return profiling.profile(clean_accounts(spark, sf), exact=False)


FEATURES = [n for n in NAMES if n not in ("customerID", "Churn")]


@query("e02_profile_sketch_bound", " union all ".join(
    f"select '{c}' as \"column\", true as within" for c in ["doc_id", "text", "lang", "source", "n_chars"]))
def e02_sketch_bound(spark, sf):
    """Whole documents: the sketch's distinct counts are within 5 % of the exact ones, which count long texts by digest."""
    docs = table(spark, sf, "documents")
    sketch = profiling.profile(docs, exact=False).select("column", F.col("unique").alias("near"))
    return profiling.profile(docs).join(sketch, "column").select(
        "column", (F.abs(F.col("near") - F.col("unique")) <= F.greatest(F.col("unique") * 0.05, F.lit(1))).alias("within"))


@query("e02_profile_documents", " union all ".join(
    f"select {i} as position, '{c}' as \"column\", '{t}' as type, count(*) filter ({c} is null) as missing, "
    f"count(distinct {c}) as unique from documents" for i, (c, t) in enumerate(
        [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")], start=1)))
def e02_documents(spark, sf):
    return profiling.profile(table(spark, sf, "documents"))


@query("e03_missing_by_feature", over("accounts", CLEAN) + """select "column", missing from (""" + " union all ".join(
    f"select {i} as position, '{c}' as \"column\", count(*) filter ({c} is null) as missing from ca"
    for i, c in enumerate(FEATURES)) + ") order by missing desc, position limit 10")
def e03(spark, sf):
    return profiling.missing_by_feature(clean_accounts(spark, sf).select(*FEATURES), 10)


@query("e04_distinct_customers", "select 1 as position, 'Customers' as metric, count(distinct user_id)::double as value "
       "from events union all select 2, 'Records', count(*)::double from events")
def e04(spark, sf):
    events = table(spark, sf, "events")
    known = profiling.business_kpis(events, {"customer_id": "user_id"})
    return known.unionByName(profiling.business_kpis(events, {}).withColumn("position", F.lit(2)))


@query("e05_business_kpis", over("accounts", CLEAN) + """
select 1 as position, 'Customers' as metric, count(distinct customerID)::double as value from ca
union all select 2, 'Average MonthlyCharges', round(avg(MonthlyCharges), 9) from ca
union all select 3, 'Average tenure', round(avg(tenure), 9) from ca
union all select 4, 'Positive/Churn Rate', round(count(*) filter (lower(Churn) = 'yes')::double * 1e2 / count(*), 9)
  from ca""")
def e05(spark, sf):
    return stable(profiling.business_kpis(clean_accounts(spark, sf), TYPED_ROLES), "value")


@query("e05_business_kpis_customers", over("customers") + """
select 1 as position, 'Customers' as metric, count(distinct id)::double as value from customers
union all select 2, 'Average usage', round(avg(usage), 9) from customers
union all select 3, 'Total tickets', sum(tickets)::double from customers""")
def e05_customers(spark, sf):
    found = {"customer_id": "id", "usage": "usage", "tickets": "tickets"}
    return stable(profiling.business_kpis(views.customers(spark, sf), found), "value")


@query("e05_business_kpis_exact", """
select 1 as position, 'Records' as metric, count(*)::double as value from lineitem
union all select 2, 'Average charge', sum(cast(round(l_extendedprice * 1e3) as bigint) + l_linenumber)::double / 1e3
  / count(l_extendedprice) from lineitem
union all select 3, 'Average quantity', sum(l_quantity::bigint)::double / count(l_quantity) from lineitem
union all select 4, 'Total tax', sum(cast(round(l_tax * 1e2) as bigint))::double / 1e2 from lineitem""")
def e05_exact(spark, sf):
    """Money to a tenth of a cent, dealt over other partitions: every digit stays the same."""
    charge = (F.rint(F.col("l_extendedprice") * 1000).cast("long") + F.col("l_linenumber")) / 1000
    dealt = table(spark, sf, "lineitem").repartition(13, "l_partkey").withColumns(
        {"charge": charge, "quantity": F.col("l_quantity").cast("double"), "tax": F.col("l_tax").cast("double")})
    return profiling.business_kpis(dealt, {"revenue": "charge", "tenure": "quantity", "tickets": "tax"})


@query("e06_positive_rate", over("accounts") + """
select round(count(*) filter (lower(trim(Churn)) in ('yes', 'true', '1', 'churned', 'cancelled', 'canceled', 'left',
  'exited'))::double * 1e2 / count(*), 9) as positive_rate from accounts""")
def e06(spark, sf):
    return stable(profiling.positive_rate(raw_accounts(spark, sf), "Churn"), "positive_rate")


@query("e14_outcome_by_contract", over("accounts", CLEAN) + """
select Contract as contract, Churn as outcome, count(*) as customers from ca group by all""")
def e14(spark, sf):
    frame = clean_accounts(spark, sf)
    return profiling.outcome_by_contract(frame, roles.roles_of(frame))


@query("e15_value_counts", over("accounts", CLEAN) + """
select PaymentMethod as value, count(*) as count from ca where PaymentMethod is not null group by 1
order by 2 desc, 1 limit 20""")
def e15(spark, sf):
    return profiling.value_counts(clean_accounts(spark, sf), "PaymentMethod")


@query("e15_value_counts_customer", """
select c_name as value, count(*) as count from customer join orders on c_custkey = o_custkey group by 1
order by 2 desc, 1 limit 20""")
def e15_customer(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return profiling.value_counts(orders.join(table(spark, sf, "customer"), "c_custkey"), "c_name")


@query("e16_value_counts_numeric", """
select l_quantity as value, count(*) as count from lineitem where l_quantity is not null group by 1
order by 2 desc, 1 limit 20""")
def e16(spark, sf):
    return profiling.value_counts(table(spark, sf, "lineitem"), "l_quantity")


@query("e17_distribution", over("accounts", CLEAN) + """
select Churn as value, count(*) as customers, count(*)::double / sum(count(*)) over () as share from ca
where Churn is not null group by 1""")
def e17(spark, sf):
    return profiling.distribution(clean_accounts(spark, sf), "Churn")


def _histogram(column: str, source: str, bins: int = 30) -> str:
    width = f"((hi - lo) / {bins})"
    return f"""select b.bin, lo + (b.bin - 1) * {width} as lower, lo + b.bin * {width} as upper,
      coalesce(n, 0) as count
    from (select min({column})::double as lo, max({column})::double as hi from {source})
    cross join (select unnest(range(1, {bins + 1}))::int as bin) b
    left join (select least(floor(({column} - lo) / {width})::int + 1, {bins}) as bin, count(*) as n from {source},
      (select min({column})::double as lo, max({column})::double as hi from {source})
      where {column} is not null group by 1) c using (bin)"""


@query("e19_histogram", over("accounts", CLEAN) + _histogram("MonthlyCharges", "ca"))
def e19(spark, sf):
    return profiling.histogram(clean_accounts(spark, sf), "MonthlyCharges")


@query("e19_histogram_lineitem", _histogram("l_extendedprice", "lineitem"))
def e19_lineitem(spark, sf):
    return profiling.histogram(table(spark, sf, "lineitem"), "l_extendedprice")


def quantile_sql(column: str, source: str, points: list[float], by: str = "1") -> str:
    """Linear quantiles by rank, spelled out so that both engines do the same arithmetic."""
    picks = []
    for i, p in enumerate(points):
        position = f"((n - 1) * {p!r}::double)"
        low = f"max(v) filter (r = floor({position}))"
        high = f"max(v) filter (r = ceil({position}))"
        share = f"max({position} - floor({position}))"
        picks.append(f"case when {share} >= 5e-1 then {high} - ({high} - {low}) * (1 - {share}) "
                     f"else {low} + ({high} - {low}) * {share} end as q{i}")
    return f"""(select g, max(n) as n, {', '.join(picks)} from (
      select {by} as g, {column}::double as v, row_number() over (partition by {by} order by {column}) - 1 as r,
             count(*) over (partition by {by}) as n
      from {source} where {column} is not null) group by g)"""


def _box(column: str, source: str, by: str = "1", keep: str = "") -> str:
    return f"""fences as (select *, q0 - (q2 - q0) * 15e-1 as lo, q2 + (q2 - q0) * 15e-1 as hi
      from {quantile_sql(column, source, [0.25, 0.5, 0.75], by)}),
    box as (select {keep} max(n) as n, max(q0) as q1, max(q1) as median, max(q2) as q3, max(lo) as lower_fence,
      max(hi) as upper_fence, min({column})::double as minimum, max({column})::double as maximum,
      min({column}) filter ({column} between lo and hi)::double as lower_whisker,
      max({column}) filter ({column} between lo and hi)::double as upper_whisker,
      count(*) filter ({column} not between lo and hi) as outliers
      from {source} join fences on g = {by} where {column} is not null group by g)"""


@query("e20_box_stats", over("accounts", CLEAN, _box("TotalCharges", "ca")) + "select * from box")
def e20(spark, sf):
    return profiling.box_stats(clean_accounts(spark, sf), "TotalCharges")


@query("e20_box_stats_lineitem", "with " + _box("l_extendedprice", "lineitem") + "select * from box")
def e20_lineitem(spark, sf):
    return profiling.box_stats(table(spark, sf, "lineitem"), "l_extendedprice")


@query("e20_box_stats_sketch")
def e20_sketch(spark, sf):
    return profiling.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", exact=False)


STATUS = CLEAN + """,
st as (select *, case label when 0 then 'Retained' when 1 then 'Churned' end as status from ca
       where label is not null)"""


def by_status(spark, sf):
    label = F.col("label")
    status = F.when(label == 0, F.lit("Retained")).when(label == 1, F.lit("Churned"))
    return typed_accounts(uploaded(spark, sf)).dropna(subset=["label"]).withColumn("status", status)


@query("e21_box_by_status", over("accounts", STATUS, _box("MonthlyCharges", "st", "status", "g as status,"))
       + "select * from box")
def e21(spark, sf):
    return profiling.box_stats(by_status(spark, sf), "MonthlyCharges", "status")


@query("e21_outliers_by_status", over("accounts", STATUS, _box("TotalCharges", "st", "status", "g as status,")) + """
select status, customerID, TotalCharges as value from st join fences on g = status
where TotalCharges not between lo and hi""")
def e21_outliers(spark, sf):
    return profiling.outliers(by_status(spark, sf), "TotalCharges", "customerID", "status")


NUMERIC = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
PAIRS = [(i, j) for i in range(len(NUMERIC)) for j in range(i + 1, len(NUMERIC))]


def _correlations(columns: list[str], source: str) -> str:
    return " union all ".join(
        f"select {i} as i, {j} as j, '{a}' as first, '{b}' as second, corr({a}, {b}) as r from {source}"
        for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j)


@query("e22_correlations", over("accounts", CLEAN) + f"""
select i, j, first, second, round(r, 9) as correlation from ({_correlations(NUMERIC, 'ca')})""")
def e22(spark, sf):
    return stable(profiling.correlations(clean_accounts(spark, sf)), "correlation")


ITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("e22_correlations_lineitem", f"""
select i, j, first, second, round(r, 9) as correlation from ({_correlations(ITEM_NUMBERS, 'lineitem')})""")
def e22_lineitem(spark, sf):
    return stable(profiling.correlations(table(spark, sf, "lineitem")), "correlation")


WIDE = 200
WIDE_COLUMNS = [f"case when (l_orderkey * {3 + 2 * k} + l_linenumber) % {11 + k % 7} = {k % 11} then null else "
                f"(l_partkey * {1 + k} + l_suppkey) % {97 + k} end as c{k}" for k in range(WIDE)]
CHOSEN = [(i, j) for i, j in [(0, 1), (0, 199), (31, 32), (63, 64), (5, 150), (120, 121), (198, 199), (17, 90)]]


@query("e22_correlations_wide", f"with w as (select {', '.join(WIDE_COLUMNS)} from lineitem)\n" + " union all ".join(
    f"select {i} as i, {j} as j, round(corr(c{i}, c{j}), 9) as correlation from w" for i, j in CHOSEN)
       + f" union all select -1, -1, {WIDE * (WIDE - 1) // 2}")
def e22_wide(spark, sf):
    """200 columns with gaps of their own: all 19,900 pairs, of which SQL recomputes some; the last row counts them."""
    wide = table(spark, sf, "lineitem").selectExpr(*WIDE_COLUMNS)
    pairs = profiling.correlations(wide)
    wanted = F.lit(False)
    for i, j in CHOSEN:
        wanted = wanted | ((F.col("i") == i) & (F.col("j") == j))
    place = F.when(wanted, F.struct("i", "j", F.round("correlation", 9).alias("correlation")))
    rows = pairs.agg(F.collect_list(place).alias("some"), F.count("correlation").alias("n"))
    counted = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.col("n").cast("double").alias("correlation")))
    return rows.select(F.inline(F.concat("some", counted)))


@query("e23_strongest_pair", over("accounts", CLEAN) + f"""
select first, second, round(abs(r), 9) as strength from ({_correlations(NUMERIC, 'ca')})
where r is not null and not isnan(r) order by abs(r) desc, i, j limit 1""")
def e23(spark, sf):
    return stable(profiling.strongest_pair(clean_accounts(spark, sf)), "strength")


@query("e24_executive_summary", over("accounts", CLEAN, f"o as ({_overview(NAMES, 'ca')})",
                                     f"pair as (select * from ({_correlations(NUMERIC, 'ca')}) order by abs(r) desc, "
                                     "i, j limit 1)") + """
select 1 as position, format('The dataset contains {:,} records across {} columns.', rows, columns) as sentence from o
union all select 2, case when missing_values = 0 then 'No missing values were detected.'
  else format('{:,} missing values were detected.', missing_values::bigint) end from o
union all select 3, case when duplicate_rows = 0 then 'No duplicate rows were detected.'
  else format('{:,} duplicate rows were detected.', duplicate_rows::bigint) end from o
union all select 4, format('The detected churn rate is {:.1f}%.',
  count(*) filter (lower(Churn) = 'yes')::double * 1e2 / count(*)) from ca
union all select 5, format('Average MonthlyCharges is {:,.2f}.', avg(MonthlyCharges)) from ca
union all select 6, format('Average tenure is {:,.1f}.', avg(tenure)) from ca
union all select 7, format('The strongest numeric relationship is between {} and {} (correlation {:.2f}).', first,
  second, abs(r)) from pair""")
def e24(spark, sf):
    return profiling.executive_summary(clean_accounts(spark, sf), TYPED_ROLES)


@query("e28_scatter_points", over("accounts", CLEAN) + """
select tenure::double as x, MonthlyCharges as y, Churn as color, customerID as id from ca""")
def e28(spark, sf):
    return profiling.scatter_points(clean_accounts(spark, sf), "tenure", "MonthlyCharges", "Churn", "customerID")


@query("e28_scatter_bins", over("accounts", CLEAN) + """
select least(floor((x - x0) / ((x1 - x0) / 20))::int + 1, 20) as bin_x,
       least(floor((y - y0) / ((y1 - y0) / 20))::int + 1, 20) as bin_y, count(*) as count
from (select tenure::double as x, TotalCharges as y from ca where TotalCharges is not null),
     (select min(tenure)::double as x0, max(tenure)::double as x1, min(TotalCharges) as y0, max(TotalCharges) as y1
      from ca where TotalCharges is not null)
group by all""")
def e28_bins(spark, sf):
    return profiling.scatter_bins(clean_accounts(spark, sf), "tenure", "TotalCharges")
