"""Business rules as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepwell import domain
from keepwell.domain import DEFAULT_POLICY, RiskPolicy
from keepwell.functions.values import as_column, strip, to_number


def pick(column: Column, texts: dict[str, str]) -> Column:
    """The text filed under the column's value."""
    chosen = None
    for key, text in texts.items():
        matches = column == F.lit(key)
        chosen = F.when(matches, F.lit(text)) if chosen is None else chosen.when(matches, F.lit(text))
    return chosen


# ---- labels -------------------------------------------------------------------------------------
def parse_label(column: Column | str) -> Column:
    """Yes / No to 1 / 0 whatever the case and padding; anything else is NULL."""
    text = F.lower(strip(column))
    return F.when(text == "yes", F.lit(1)).when(text == "no", F.lit(0))


def is_positive(column: Column | str, labels: Sequence[str] = tuple(domain.POSITIVE_LABELS)) -> Column:
    """Does the value read as a positive outcome? NULL is not positive; a number 1 is, whatever its type."""
    text = F.lower(strip(column))
    positive = text.isin(list(labels))
    if "1" in labels:
        positive = positive | (to_number(column) == 1)
    return F.coalesce(positive, F.lit(False))


def churn_status(label: Column | str) -> Column:
    label = as_column(label)
    return F.when(label == 0, F.lit("Retained")).when(label == 1, F.lit("Churned"))


def tenure_band(column: Column | str) -> Column:
    """Right-closed bands (-1,12], (12,24], (24,48], (48,inf)."""
    months = as_column(column)
    first, second, third, last = (F.lit(band) for band in domain.TENURE_BANDS)
    return (
        F.when(months <= -1, F.lit(None))
        .when(months <= 12, first)
        .when(months <= 24, second)
        .when(months <= 48, third)
        .when(months.isNotNull(), last)
    )


def tenure_rank(band: Column | str) -> Column:
    return domain_rank(band, domain.TENURE_BANDS)


def domain_rank(column: Column | str, values: Sequence[str]) -> Column:
    """Position of a category in its domain, from 1; NULL outside it."""
    position = F.array_position(F.array(*[F.lit(v) for v in values]), as_column(column))
    return F.when(position > 0, position)


# ---- customer health ----------------------------------------------------------------------------
def health_score(usage: Column | str, nps: Column | str, tickets: Column | str) -> Column:
    return as_column(usage) * 0.5 + as_column(nps) * 5 - as_column(tickets) * 2


def health_status(score: Column | str) -> Column:
    """Compares the raw score, never the rounded one."""
    score = as_column(score)
    return (
        F.when(score >= 80, F.lit("Healthy"))
        .when(score >= 60, F.lit("At Risk"))
        .when(score.isNotNull(), F.lit("Critical"))
    )


def health_recommendation(status: Column | str) -> Column:
    return pick(as_column(status), domain.HEALTH_TEXTS)


def renewal_risk(churn_percent: Column | str) -> Column:
    percent = as_column(churn_percent)
    return (
        F.when(percent >= 70, F.lit("High"))
        .when(percent >= 40, F.lit("Medium"))
        .when(percent.isNotNull(), F.lit("Low"))
    )


def renewal_recommendation(level: Column | str) -> Column:
    return pick(as_column(level), domain.RENEWAL_TEXTS)


# ---- churn risk ---------------------------------------------------------------------------------
def risk_tier(probability: Column | str, policy: RiskPolicy = DEFAULT_POLICY) -> Column:
    p = as_column(probability)
    return (
        F.when(p < policy.low, F.lit("LOW"))
        .when(p < policy.intervention, F.lit("MEDIUM"))
        .when(p < policy.critical, F.lit("HIGH"))
        .when(p.isNotNull(), F.lit("CRITICAL"))
    )


def threshold_position(probability: Column | str, threshold: float = DEFAULT_POLICY.intervention) -> Column:
    p = as_column(probability)
    return F.when(p >= threshold, F.lit("Above threshold")).when(p.isNotNull(), F.lit("Below threshold"))


def actions(tier: Column | str) -> Column:
    """Recommended actions in priority order, the tier's own action first, at most five in all.

    Reads the account columns Contract, TechSupport, OnlineSecurity, PaymentMethod and tenure.
    """
    advice = F.array(
        pick(as_column(tier), domain.TIER_ACTIONS),
        F.when(F.col("Contract") == "Month-to-month", F.lit(domain.CONTRACT_ACTION)),
        F.when(F.col("TechSupport") == "No", F.lit(domain.SUPPORT_ACTION)),
        F.when(F.col("OnlineSecurity") == "No", F.lit(domain.SECURITY_ACTION)),
        F.when(F.col("PaymentMethod") == "Electronic check", F.lit(domain.PAYMENT_ACTION)),
        F.when(F.col("tenure") < 12, F.lit(domain.TENURE_ACTION)),
    )
    return F.slice(F.array_compact(advice), 1, domain.MAX_ACTIONS)
