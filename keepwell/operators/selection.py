"""Searching, filtering, looking up and validating rows; top-k and ordered limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell import domain
from keepwell.domain import DEFAULT_POLICY
from keepwell.functions.rules import domain_rank
from keepwell.functions.values import quoted, strip


def search(df: DataFrame, column: str, pattern: str, literal: bool = False) -> DataFrame:
    """Rows whose text matches a case-insensitive regular expression (or a literal text); NULL never matches."""
    text = quoted(column).cast("string")
    if literal:
        return df.where(F.contains(F.lower(text), F.lower(F.lit(pattern))))
    return df.where(text.rlike("(?i)" + pattern))


def filter_in(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value is among `values`; no values, no filter."""
    return df.where(quoted(column).cast("string").isin(list(values))) if values else df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    value = quoted(column).cast("string").alias("value")
    return df.select(value).dropna().distinct().orderBy("value")


def status_column(columns: Sequence[str], roles: dict[str, str | None]) -> str | None:
    return "status" if "status" in columns else roles.get("churn")


def lookup(df: DataFrame, ids: DataFrame, key: str = "customerID") -> DataFrame:
    """Every requested id with its record and a `found` flag; ids compare as text. Of several records of one id the
    smallest counts, cell by cell from the left, NULL first."""
    wanted = ids.select(quoted(key).cast("string").alias("requested_id"))
    records = df.withColumn("_key", quoted(key).cast("string"))
    asked = records.join(wanted, F.col("_key") == F.col("requested_id"), "left_semi")
    one = asked.groupBy("_key").agg(F.min(F.struct(*[quoted(c) for c in df.columns])).alias("_record"))
    joined = wanted.join(one, F.col("requested_id") == F.col("_key"), "left")
    return joined.select("requested_id", "_record.*", F.col("_key").isNotNull().alias("found"))


def high_risk(scored: DataFrame, threshold: float = DEFAULT_POLICY.intervention) -> DataFrame:
    return scored.where(F.col("probability") >= threshold)


def high_risk_count(scored: DataFrame, threshold: float = DEFAULT_POLICY.intervention) -> DataFrame:
    return scored.agg(F.count_if(F.col("probability") >= threshold).alias("high_risk"))


def _problems() -> Column:
    """Texts for every constraint a customer record breaks."""
    def broken(ok: Column, text: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(text))

    return F.array_compact(F.array(
        broken(F.length(strip("name")) > 0, "name is blank"),
        broken(F.col("usage").between(0, 100), "usage is outside 0-100"),
        broken(F.col("tickets") >= 0, "tickets is negative"),
        broken(F.col("nps").between(0, 10), "nps is outside 0-10"),
        broken(F.col("renewal_status").isin(domain.RENEWAL_STATUSES), "renewal_status is unknown"),
    ))


def checked_customers(df: DataFrame) -> DataFrame:
    """Customer records with the `reasons` they would be rejected for; names are stripped."""
    return df.withColumn("reasons", _problems()).withColumn("name", strip("name"))


def validate_customers(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejected records with their reasons)."""
    checked = checked_customers(df)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def preview(df: DataFrame, order: Sequence[str], n: int = 1000) -> DataFrame:
    """The first n rows in a total order, each with a `truncated` flag saying whether more rows exist.

    One row beyond n is taken by the distributed top-k, so the table is never counted.
    """
    keys = [quoted(c).asc_nulls_last() for c in order]
    place = F.row_number().over(Window.orderBy(*keys))
    head = df.orderBy(*keys).limit(n + 1).select("*", place.alias("_place"))
    return (
        head.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > n)
        .where(F.col("_place") <= n).drop("_place")
    )


def top_features(importance: DataFrame, n: int = 20, ascending: bool = False) -> DataFrame:
    """The n most important features; `ascending` lists the same rows smallest first, for a bar chart."""
    top = importance.orderBy(F.desc("Importance"), F.asc("Feature")).limit(n)
    return top.orderBy(F.asc("Importance"), F.desc("Feature")) if ascending else top


def top_drivers(shap_long: DataFrame, k: int = 5, key: str = "customerID") -> DataFrame:
    """Each customer's k strongest drivers: (key, feature, shap, impact, rank)."""
    impact = F.abs("shap")
    strongest = Window.partitionBy(key).orderBy(F.desc("impact"), F.asc("feature"))
    return (
        shap_long.withColumn("impact", impact)
        .withColumn("rank", F.row_number().over(strongest))
        .where(F.col("rank") <= k)
        .select(key, "feature", "shap", "impact", "rank")
    )


def order_by_domain(df: DataFrame, column: str, values: Sequence[str], *then: str) -> DataFrame:
    """Sorted by a category's place in its domain, unknown categories last."""
    return df.orderBy(domain_rank(column, values).asc_nulls_last(), *[quoted(c) for c in then])
