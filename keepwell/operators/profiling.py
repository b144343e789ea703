"""Profiles of any table: overview, columns, KPIs by role, counts, histograms, box statistics, correlations."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell import domain
from keepwell.functions import display
from keepwell.functions.rules import is_positive
from keepwell.functions.values import exact_mean, exact_sum, quoted, row_digest, to_number
from keepwell.operators.cleaning import long_form, numeric_columns
from keepwell.operators.ordering import quantiles
from keepwell.operators.pairwise import correlation_table
from keepwell.session import stored

MAX_BROADCAST_GROUPS = 10_000
DIGEST_BYTES = 32
METRIC = "array<struct<position:int,metric:string,value:double>>"


def metric_rows(one_row: DataFrame, metrics: Sequence[tuple[str, str]]) -> DataFrame:
    """(position, metric, value) rows from a one-row aggregate; `metrics` pairs each label with its column."""
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("metric"), F.col(c).cast("double").alias("value"))
        for i, (label, c) in enumerate(metrics, start=1)
    ]
    return one_row.select(F.inline(F.array(*cells).cast(METRIC)))


def number_of(df: DataFrame, column: str) -> Column:
    """A column as a double: text is parsed, numbers are widened."""
    if isinstance(df.schema[column].dataType, T.NumericType):
        return quoted(column).cast("double")
    return to_number(column)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one.

    Rows are grouped by a SHA-256 digest of their cells, so the shuffle carries 32 bytes per distinct row instead of
    the whole table, and a row repeated a billion times is combined before it.
    """
    groups = df.select(row_digest(df).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows beyond the first."""
    missing = [F.when(quoted(c).isNull(), 1).otherwise(0) for c in df.columns]
    row_missing = F.lit(0)
    for m in missing:
        row_missing = row_missing + m
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.sum(row_missing), F.lit(0)).cast("long").alias("missing_values")).select(
        "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "missing_values",
        duplicate_rows(df).scalar().alias("duplicate_rows"))


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """(position, column, type, missing, unique) per column.

    Exact: cells become (column, value) pairs that are counted with a map-side combine, so a hot value costs one row; a
    value longer than its SHA-256 digest travels as that. Otherwise one pass with a distinct-count sketch per column.
    """
    names = df.columns
    position = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.lit(i) for i in range(1, len(names) + 1)]))
    types = F.map_from_arrays(F.array(*map(F.lit, names)),
                              F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema.fields]))
    if exact:
        long = F.octet_length("value") > DIGEST_BYTES
        digest = F.when(long, F.unhex(F.sha2(F.col("value").cast("binary"), 256))).otherwise(F.col("value").cast("binary"))
        pairs = long_form(df, names).groupBy("column", long.alias("long"), digest.alias("value")).agg(
            F.count(F.lit(1)).alias("n"))
        counted = pairs.groupBy("column").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
            F.count("value").alias("unique"))
    else:
        one_row = df.agg(
            *[F.count_if(quoted(c).isNull()).alias(f"m{i}") for i, c in enumerate(names)],
            *[F.hll_sketch_estimate(F.hll_sketch_agg(quoted(c).cast("string"))).alias(f"u{i}")
              for i, c in enumerate(names)])
        counted = one_row.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.col(f"u{i}").alias("unique"))
            for i, c in enumerate(names)])))
    return counted.select(position[F.col("column")].alias("position"), "column", types[F.col("column")].alias("type"),
                          "missing", "unique").orderBy("position")


def missing_by_feature(df: DataFrame, n: int = 10) -> DataFrame:
    """The n columns with most missing values."""
    counts = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"))
        for i, c in enumerate(df.columns)])
    return counts.select(F.inline(cells)).orderBy(F.desc("missing"), "position").limit(n).drop("position")


def positive_rate(df: DataFrame, column: str, labels: Sequence[str] = tuple(domain.POSITIVE_LABELS)) -> DataFrame:
    """One row: percent of all rows with a positive label. A missing label counts as negative."""
    return df.agg(positive_percent(column, labels).alias("positive_rate"))


def positive_percent(column: str, labels: Sequence[str] = tuple(domain.POSITIVE_LABELS)) -> Column:
    return F.try_divide(F.count_if(is_positive(column, labels)) * 100.0, F.count(F.lit(1)))


def business_kpis(df: DataFrame, roles: dict[str, str | None]) -> DataFrame:
    """(position, metric, value) for the roles the table has, from one aggregate."""
    aggregates: list[tuple[str, Column]] = []
    if roles.get("customer_id"):
        aggregates.append(("Customers", F.count_distinct(quoted(roles["customer_id"]))))
    else:
        aggregates.append(("Records", F.count(F.lit(1))))
    for role in ("revenue", "tenure"):
        if roles.get(role):
            aggregates.append((f"Average {roles[role]}", exact_mean(number_of(df, roles[role]))))
    if roles.get("churn"):
        aggregates.append(("Positive/Churn Rate", positive_percent(roles["churn"])))
    if roles.get("usage"):
        aggregates.append((f"Average {roles['usage']}", exact_mean(number_of(df, roles["usage"]))))
    if roles.get("tickets"):
        total = F.coalesce(exact_sum(number_of(df, roles["tickets"])), F.lit(0.0))
        aggregates.append((f"Total {roles['tickets']}", total))
    one_row = df.agg(*[a.alias(f"v{i}") for i, (_, a) in enumerate(aggregates)])
    return metric_rows(one_row, [(label, f"v{i}") for i, (label, _) in enumerate(aggregates)])


def value_counts(df: DataFrame, column: str, n: int | None = 20) -> DataFrame:
    """The n most frequent values (all when n is None), ties by value; missing values are not a value."""
    value = quoted(column).alias("value")
    counted = df.select(value).dropna().groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    ordered = counted.orderBy(F.desc("count"), F.asc("value"))
    return ordered if n is None else ordered.limit(n)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, customers, share) of every non-missing value."""
    counted = value_counts(df, column, None).withColumnRenamed("count", "customers")
    total = counted.agg(F.sum("customers").alias("total"))
    return counted.withColumn("share", F.try_divide(F.col("customers").cast("double"), total.scalar().cast("double")))


def outcome_by_contract(df: DataFrame, roles: dict[str, str | None]) -> DataFrame:
    """Rows per (contract, outcome), missing values kept as a group."""
    return df.groupBy(quoted(roles["contract"]).alias("contract"), quoted(roles["churn"]).alias("outcome")).agg(
        F.count(F.lit(1)).alias("customers"))


def _bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin from 1 to `bins`; the maximum belongs to the last bin, a constant column to the first."""
    width = (high - low) / bins
    place = F.floor(F.try_divide(value - low, width)).cast("int") + 1
    return F.when(value.isNotNull(), F.least(F.coalesce(place, F.lit(1)), F.lit(bins)))


def _limits(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("limits"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, lower, upper, count) over equal-width bins, empty bins included."""
    values = df.select(number_of(df, column).alias("value"))
    limits = _limits(values, F.col("value"))
    binned = (
        values.where(F.col("value").isNotNull()).withColumn("limits", limits.scalar())
        .select(_bin_of(F.col("value"), F.col("limits.low"), F.col("limits.high"), bins).alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    )
    width = (F.col("high") - F.col("low")) / bins
    every = limits.select("limits.*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return every.join(binned, "bin", "left").select(
        "bin", (F.col("low") + (F.col("bin") - 1) * width).alias("lower"),
        (F.col("low") + F.col("bin") * width).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count")).orderBy("bin")


def box_fences(df: DataFrame, column: str, by: str | None = None, exact: bool = True) -> DataFrame:
    """(by, n, q1, median, q3, lower_fence, upper_fence) with fences 1.5 interquartile ranges out."""
    group = [by] if by else []
    table = quantiles(df.select(*group, number_of(df, column).alias("value")), "value", [0.25, 0.5, 0.75], group, exact)
    q1, median, q3 = (F.get("quantiles", i) for i in range(3))
    reach = (q3 - q1) * 1.5
    return table.select(*group, "n", q1.alias("q1"), median.alias("median"), q3.alias("q3"),
                        (q1 - reach).alias("lower_fence"), (q3 + reach).alias("upper_fence"))


def _with_fences(df: DataFrame, column: str, by: str | None, exact: bool, *keep: str) -> DataFrame:
    group = [by] if by else []
    values = df.select(*group, *keep, number_of(df, column).alias("value")).where(F.col("value").isNotNull())
    fences = box_fences(df, column, by, exact)
    if by:
        # a column of few groups must not send each group to one task; the fences are counted before they are broadcast
        fences = stored(fences, "fences")
        few = fences.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
        return values.join(F.broadcast(fences) if few else fences, by)
    fence = fences.select(F.struct("*").alias("fence")).scalar()
    return values.withColumn("_fence", fence).select(*values.columns, "_fence.*")


def box_stats(df: DataFrame, column: str, by: str | None = None, exact: bool = True) -> DataFrame:
    """Box-plot numbers: quartiles, fences, whisker ends (last values inside the fences) and the outlier count."""
    group = [by] if by else []
    fenced = _with_fences(df, column, by, exact)
    inside = F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    fence_columns = ["n", "q1", "median", "q3", "lower_fence", "upper_fence"]
    return fenced.groupBy(*group).agg(
        *[F.max(c).alias(c) for c in fence_columns],
        F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        F.min(F.when(inside, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("upper_whisker"),
        F.count_if(~inside).alias("outliers"))


def outliers(df: DataFrame, column: str, key: str, by: str | None = None, exact: bool = True) -> DataFrame:
    """The rows beyond the fences: (by, key, value)."""
    group = [by] if by else []
    fenced = _with_fences(df, column, by, exact, key)
    return fenced.where(~F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))).select(
        *group, key, "value")


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(i, j, first, second, correlation) for every pair of numeric columns, from one scan; see `correlation_table`."""
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, first string, second string, correlation double")
    # one literal, as a wide table has many names
    names = F.from_json(F.lit(json.dumps(columns)), "array<string>")
    return correlation_table(df, columns).select(
        "i", "j", F.get(names, F.col("i")).alias("first"), F.get(names, F.col("j")).alias("second"), "correlation")


def strongest_pair(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The pair with the largest absolute correlation, the earlier pair on ties."""
    strength = F.abs("correlation")
    return (
        correlations(df, columns).where(F.col("correlation").isNotNull())
        .select("i", "j", "first", "second", strength.alias("strength"))
        .orderBy(F.desc("strength"), "i", "j").limit(1).drop("i", "j")
    )


def executive_summary(df: DataFrame, roles: dict[str, str | None]) -> DataFrame:
    """(position, sentence): size, missing values, duplicates, churn rate, averages, strongest relationship."""
    def found(count: Column, what: str) -> Column:
        return F.when(count == 0, F.lit(f"No {what} were detected.")).otherwise(
            F.concat(display.fmt_int(count), F.lit(f" {what} were detected.")))

    rates: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    if roles.get("churn"):
        rates.append(positive_percent(roles["churn"]).alias("churn"))
    for role in ("revenue", "tenure"):
        if roles.get(role):
            rates.append(exact_mean(number_of(df, roles[role])).alias(role))
    means = df.agg(*rates).select(F.struct("*").alias("means")).scalar()
    sentences = [
        F.concat(F.lit("The dataset contains "), display.fmt_int("rows"), F.lit(" records across "),
                 F.col("columns").cast("string"), F.lit(" columns.")),
        found(F.col("missing_values"), "missing values"),
        found(F.col("duplicate_rows"), "duplicate rows"),
    ]
    if roles.get("churn"):
        sentences.append(F.concat(F.lit("The detected churn rate is "), display.fmt_pct(F.col("means.churn")), F.lit(".")))
    for role, digits in (("revenue", 2), ("tenure", 1)):
        if roles.get(role):
            sentences.append(F.concat(F.lit(f"Average {roles[role]} is "),
                                      display.fmt_int(F.col(f"means.{role}"), digits), F.lit(".")))
    numeric = numeric_columns(df)
    if len(numeric) >= 2:
        pair = strongest_pair(df, numeric).select(F.struct("*").alias("pair")).scalar()
        sentences.append(F.concat(
            F.lit("The strongest numeric relationship is between "), F.col("pair.first"), F.lit(" and "),
            F.col("pair.second"), F.lit(" (correlation "), display.fixed(F.col("pair.strength"), 2), F.lit(").")))
    base = overview(df).withColumn("means", means)
    if len(numeric) >= 2:
        base = base.withColumn("pair", pair)
    return base.select(F.posexplode(F.array(*sentences)).alias("position", "sentence")).where(
        F.col("sentence").isNotNull()).select((F.col("position") + 1).alias("position"), "sentence")


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None, key: str | None = None) -> DataFrame:
    """The points of a scatter chart: two numbers, an optional colour and an optional id."""
    extra = [quoted(c).alias(n) for c, n in ((color, "color"), (key, "id")) if c]
    return df.select(number_of(df, x).alias("x"), number_of(df, y).alias("y"), *extra)


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """The whole scatter as counts on a bins x bins grid: (bin_x, bin_y, count)."""
    points = df.select(number_of(df, x).alias("x"), number_of(df, y).alias("y")).dropna()
    limits = points.agg(F.struct(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    return points.select("x", "y", limits.scalar().alias("at")).groupBy(
        _bin_of(F.col("x"), F.col("at.x0"), F.col("at.x1"), bins).alias("bin_x"),
        _bin_of(F.col("y"), F.col("at.y0"), F.col("at.y1"), bins).alias("bin_y")).agg(F.count(F.lit(1)).alias("count"))
