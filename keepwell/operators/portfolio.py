"""Portfolio reports over the telecom table and the customer-success accounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell import domain
from keepwell.domain import DEFAULT_POLICY
from keepwell.functions import display
from keepwell.functions.rules import (
    domain_rank, health_recommendation, health_score, health_status, tenure_band, tenure_rank)
from keepwell.functions.values import exact_mean, exact_sum, quoted
from keepwell.operators.profiling import positive_percent, metric_rows, number_of


def churn_rate(label: str = "label") -> Column:
    """Percent of churned customers among those with a label."""
    return F.try_divide(F.sum(label) * 100.0, F.count(label))


def portfolio_kpis(accounts: DataFrame) -> DataFrame:
    """(position, metric, value): customers, churn rate, mean charges, mean tenure, churned customers."""
    one_row = accounts.agg(
        F.count(F.lit(1)).alias("customers"), churn_rate().alias("rate"), exact_mean("MonthlyCharges").alias("charges"),
        exact_mean("tenure").alias("tenure"), F.coalesce(F.sum("label"), F.lit(0)).alias("churned"))
    return metric_rows(one_row, [
        ("Total Customers", "customers"), ("Overall Churn Rate", "rate"), ("Average Monthly Charges", "charges"),
        ("Average Tenure", "tenure"), ("Churned Customers", "churned")])


def churn_by(accounts: DataFrame, column: str) -> DataFrame:
    """(column, customers, churn_rate) per category; rows without a category or a label are left out."""
    return accounts.dropna(subset=[column, "label"]).groupBy(column).agg(
        F.count("customerID").alias("customers"), churn_rate().alias("churn_rate"))


def churn_by_contract(accounts: DataFrame) -> DataFrame:
    summary = churn_by(accounts, "Contract").withColumn("rank", domain_rank("Contract", domain.CONTRACT_ORDER))
    return summary.orderBy(F.col("rank").asc_nulls_last(), "Contract")


def churn_by_payment(accounts: DataFrame) -> DataFrame:
    return churn_by(accounts, "PaymentMethod").orderBy(F.desc("churn_rate"), "PaymentMethod")


def churn_by_internet(accounts: DataFrame) -> DataFrame:
    return churn_by(accounts, "InternetService").orderBy(F.desc("churn_rate"), "InternetService")


def segment_summary(accounts: DataFrame) -> DataFrame:
    """(segment, customer_count, churn_rate, rank) per tenure band, bands in order."""
    banded = accounts.withColumn("segment", tenure_band("tenure"))
    return churn_by(banded, "segment").select(
        "segment", F.col("customers").alias("customer_count"), "churn_rate",
        tenure_rank("segment").alias("rank")).orderBy("rank")


def segment_table(accounts: DataFrame) -> DataFrame:
    """The segment summary as it is displayed."""
    return segment_summary(accounts).select(
        F.col("segment").alias("Segment"), F.col("customer_count").alias("Customer Count"),
        display.fmt_pct("churn_rate").alias("Churn Rate"))


BREAKDOWNS = ["Contract", "PaymentMethod", "InternetService", "Tenure Band"]


def churn_breakdowns(accounts: DataFrame) -> DataFrame:
    """(dimension, value, customers, churn_rate) for all four breakdowns in one scan.

    Rows are first counted per combination of the four categories, so the grouping sets expand combinations, not rows.
    """
    cells = (
        accounts.dropna(subset=["label"]).withColumn("Tenure Band", tenure_band("tenure"))
        .groupBy(*BREAKDOWNS)
        .agg(F.count("customerID").alias("ids"), F.count("label").alias("labels"), F.sum("label").alias("churned"))
    )
    columns = [quoted(c) for c in BREAKDOWNS]
    rolled = cells.groupingSets([[c] for c in columns], *columns).agg(
        F.sum("ids").alias("customers"), F.sum("labels").alias("labels"), F.sum("churned").alias("churned"),
        F.grouping_id().alias("set"))
    # a grouping id has a 0 bit for the one column that is grouped
    sets = {0b1111 ^ (1 << (3 - i)): c for i, c in enumerate(BREAKDOWNS)}
    dimension, value = None, None
    for gid, name in sets.items():
        match = F.col("set") == gid
        dimension = F.when(match, F.lit(name)) if dimension is None else dimension.when(match, F.lit(name))
        value = F.when(match, quoted(name)) if value is None else value.when(match, quoted(name))
    return rolled.select(dimension.alias("dimension"), value.alias("value"), "customers",
                         F.try_divide(F.col("churned") * 100.0, F.col("labels")).alias("churn_rate")).where(
        F.col("value").isNotNull())


def executive_metrics(accounts: DataFrame, scored: DataFrame | None = None,
                      threshold: float = DEFAULT_POLICY.intervention) -> DataFrame:
    """(position, metric, value): the five exported metrics, two decimals; a missing model leaves NULL."""
    one_row = accounts.agg(
        F.count(F.lit(1)).cast("double").alias("customers"), display.rounded(churn_rate(), 2).alias("rate"),
        display.rounded(exact_mean("MonthlyCharges"), 2).alias("charges"),
        display.rounded(exact_mean("tenure"), 2).alias("tenure"))
    risky = F.lit(None).cast("double")
    if scored is not None:
        risky = scored.agg(F.count_if(F.col("probability") >= threshold).alias("n")).scalar()
    return metric_rows(one_row.withColumn("risky", risky), [
        ("Total Customers", "customers"), ("Overall Churn Rate (%)", "rate"), ("Average Monthly Charges", "charges"),
        ("Average Tenure (Months)", "tenure"), ("High / Critical Risk Customers", "risky")])


def class_balance(labelled: DataFrame, features: Sequence[str], by: str | None = None) -> DataFrame:
    """(by, rows, features, positives, negatives, churn_rate) of the labelled table."""
    return labelled.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(features)).cast("long").alias("features"),
        F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"),
        churn_rate().alias("churn_rate"))


def with_health(customers: DataFrame) -> DataFrame:
    """Customers with their health score, status and recommendation: a projection over one scan."""
    return (
        customers.withColumn("health_score", health_score("usage", "nps", "tickets"))
        .withColumn("status", health_status("health_score"))
        .withColumn("recommendation", health_recommendation("status"))
    )


def health_ranking(customers: DataFrame) -> DataFrame:
    return with_health(customers).orderBy(F.desc("health_score"), "id")


def cs_kpis(df: DataFrame, roles: dict[str, str | None] | None = None) -> DataFrame:
    """(position, metric, value) of a customer-success portfolio from one aggregate.

    A missing column falls back to the revenue, tenure or churn role; with neither, the metric is absent.
    """
    roles = roles or {}
    aggregates: list[tuple[str, Column]] = [("Customers", F.count(F.lit(1)).cast("double"))]

    def add(column: str, label: str, fallbacks: Sequence[tuple[str, str]], combine=exact_mean) -> None:
        if column in df.columns:
            aggregates.append((label, combine(number_of(df, column))))
            return
        for role, fallback in fallbacks:
            if roles.get(role):
                rate = role == "churn"
                value = (positive_percent(roles[role], domain.OLDER_POSITIVE_LABELS) if rate
                         else exact_mean(number_of(df, roles[role])))
                aggregates.append((fallback, value))
                return

    add("usage", "Average Usage", [("revenue", "Average Monthly Charges")])
    add("tickets", "Average Tickets", [("tenure", "Average Tenure")])
    add("nps", "Average NPS", [("churn", "Churn Rate")])
    add("health_score", "Average Health", [("revenue", "Average Monthly Charges"), ("tenure", "Average Tenure")])
    add("tickets", "Open Tickets", [("tenure", "Average Tenure")], exact_sum)
    seen, kept = set(), []
    for label, aggregate in aggregates:
        if label not in seen:
            seen.add(label)
            kept.append((label, aggregate))
    one_row = df.agg(*[a.alias(f"v{i}") for i, (_, a) in enumerate(kept)])
    return metric_rows(one_row, [(label, f"v{i}") for i, (label, _) in enumerate(kept)])
