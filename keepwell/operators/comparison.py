"""Customer profile cards and side-by-side comparisons for any number of customers at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell import domain
from keepwell.domain import DEFAULT_POLICY, RiskPolicy
from keepwell.functions import display
from keepwell.functions.rules import actions, risk_tier, threshold_position
from keepwell.functions.values import or_missing, to_number
from keepwell.operators.selection import lookup

MONEY = {"MonthlyCharges", "TotalCharges"}


def shown(column: str, value: Column) -> Column:
    """A profile field as it is displayed."""
    if column == "tenure":
        value = display.fmt_months(value)
    elif column in MONEY:
        value = display.fmt_money(to_number(value))
    return or_missing(value, domain.MISSING_TEXT)


def customer_summary(accounts: DataFrame, ids: DataFrame) -> DataFrame:
    """(requested_id, position, detail, value): the profile card of every requested customer that exists."""
    cards = lookup(accounts, ids).where("found")
    fields = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("detail"), shown(c, F.col(c)).alias("value"))
        for i, (label, c) in enumerate(domain.SUMMARY_FIELDS.items(), start=1)])
    return cards.select("requested_id", F.inline(fields))


def paired(scored: DataFrame, pairs: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Pairs (`a`, `b`) with both records as structs `ra`, `rb` and a `status`.

    A customer compared with itself, or one that does not exist, is reported in `status` rather than compared. Of several
    records of one id the smallest counts, field by field.
    """
    columns = list(columns or dict.fromkeys([*domain.COMPARISON_FIELDS.values(), "probability"]))
    record = scored.groupBy(F.col("customerID").cast("string").alias("_id")).agg(F.min(F.struct(*columns)).alias("_r"))

    def side(df: DataFrame, key: str) -> DataFrame:
        other = record.select(F.col("_id").alias(f"_{key}"), F.col("_r").alias(f"r{key}"))
        return df.join(other, F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")

    status = (
        F.when(F.col("a") == F.col("b"), F.lit("same customer"))
        .when(F.col("ra").isNull() | F.col("rb").isNull(), F.lit("not found"))
        .otherwise(F.lit("compared"))
    )
    return side(side(pairs, "a"), "b").withColumn("status", status)


def compare_customers(scored: DataFrame, pairs: DataFrame, policy: RiskPolicy = DEFAULT_POLICY) -> DataFrame:
    """(a, b, position, metric, customer_a, customer_b): the compared fields, probability, tier and position."""
    both = paired(scored, pairs).where(F.col("status") == "compared")
    rows = [
        (label, shown(c, F.col(f"ra.{c}")), shown(c, F.col(f"rb.{c}")))
        for label, c in domain.COMPARISON_FIELDS.items()
    ]
    for label, text in [
        ("Predicted Churn Probability", lambda p: display.fmt_pct(p * 100)),
        ("Risk Tier", lambda p: risk_tier(p, policy)),
        ("Intervention Threshold Position", lambda p: threshold_position(p, policy.intervention)),
    ]:
        rows.append((label, text(F.col("ra.probability")), text(F.col("rb.probability"))))
    scored_rows = len(domain.COMPARISON_FIELDS)
    table = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("metric"), a.alias("customer_a"),
                 b.alias("customer_b"))
        for i, (label, a, b) in enumerate(rows, start=1)])
    both_scored = F.col("ra.probability").isNotNull() & F.col("rb.probability").isNotNull()
    # without a prediction for both customers only the profile fields are compared
    visible = F.when(both_scored, table).otherwise(F.slice(table, 1, scored_rows))
    return both.select("a", "b", F.inline(visible))


def customer_differences(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, position, difference): sentences on what sets two customers apart."""
    both = paired(scored, pairs).where(F.col("status") == "compared")

    def of(name: str) -> tuple[Column, Column]:
        return F.col(f"ra.{name}"), F.col(f"rb.{name}")

    def leads(a_wins: Column, text: str) -> Column:
        return F.concat(F.when(a_wins, F.lit("Customer A")).otherwise(F.lit("Customer B")), F.lit(text))

    tenure_a, tenure_b = of("tenure")
    shorter = F.when(tenure_a < tenure_b, F.lit("Customer A has shorter tenure than Customer B.")).otherwise(
        F.lit("Customer B has shorter tenure than Customer A."))
    charges_a, charges_b = of("MonthlyCharges")
    p_a, p_b = of("probability")
    sentences = [
        F.when(tenure_a != tenure_b, shorter),  # a missing tenure is not shorter than another
        F.when(charges_a != charges_b, leads(charges_a > charges_b, " has higher monthly charges.")),
    ]
    for label, column in [
        ("contract", "Contract"), ("internet service", "InternetService"), ("payment method", "PaymentMethod"),
        ("Tech Support", "TechSupport"), ("Online Security", "OnlineSecurity"),
    ]:
        a, b = of(column)
        text = F.concat(
            F.lit(f"The customers differ in {label}: Customer A has "), or_missing(a, domain.MISSING_TEXT),
            F.lit(", while Customer B has "), or_missing(b, domain.MISSING_TEXT), F.lit("."))
        sentences.append(F.when(~a.eqNullSafe(b), text))
    sentences.append(F.when(p_a != p_b, leads(p_a > p_b, " has the higher predicted churn probability.")))
    return both.select("a", "b", F.posexplode(F.array_compact(F.array(*sentences))).alias("i", "difference")).select(
        "a", "b", (F.col("i") + 1).alias("position"), "difference")


def comparison_takeaway(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, gap, takeaway): the gap in percentage points and who is at higher risk."""
    both = paired(scored, pairs, ["probability"]).where(F.col("status") == "compared")
    p_a, p_b = F.col("ra.probability"), F.col("rb.probability")
    gap = F.abs(p_a - p_b) * 100

    def higher(first: str, second: str) -> Column:
        return F.concat(F.lit(f"Customer {first} has a predicted churn risk "), display.fixed(gap, 1),
                        F.lit(f" percentage points higher than Customer {second}."))

    text = (
        F.when(p_a > p_b, higher("A", "B")).when(p_b > p_a, higher("B", "A"))
        .when(p_a == p_b, F.lit("Customer A and Customer B have the same predicted churn probability."))
        .otherwise(F.lit("A predicted-risk takeaway is unavailable."))
    )
    return both.select("a", "b", gap.alias("gap"), text.alias("takeaway"))


def pair_status(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    return paired(scored, pairs, ["probability"]).select("a", "b", "status")


def recommend(scored: DataFrame, policy: RiskPolicy = DEFAULT_POLICY) -> DataFrame:
    """Scored accounts with their risk tier and recommended actions."""
    return scored.withColumn("risk_tier", risk_tier("probability", policy)).withColumn("actions", actions("risk_tier"))


def explode_actions(recommended: DataFrame, key: str = "customerID") -> DataFrame:
    """(key, number, action), numbered from 1."""
    return recommended.select(key, F.posexplode("actions").alias("i", "action")).select(
        key, (F.col("i") + 1).alias("number"), "action")
