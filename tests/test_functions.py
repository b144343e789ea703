"""Boundaries of the scalar functions and rules."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from keepwell import domain
from keepwell.domain import RiskPolicy
from keepwell.functions import display, rules, values
from keepwell.functions.values import exact_mean, exact_sum


def column(spark, items, kind, expression):
    """The expression's values over rows (id, v), in order."""
    rows = [(i, v) for i, v in enumerate(items)]
    df = spark.createDataFrame(rows, f"id int, v {kind}")
    return [r[0] for r in df.orderBy("id").select(expression).collect()]


def test_to_number(spark):
    texts = [" ", "", "1d", "1f", "nan", "inf", "1e3", " 7 ", "-.5", "+2.", "0x1", "1,000", None, "\t12\n", "."]
    expected = [None, None, None, None, None, None, 1000.0, 7.0, -0.5, 2.0, None, None, None, 12.0, None]
    assert column(spark, texts, "string", values.to_number("v")) == expected


def test_risk_tier(spark):
    p = [0.0, 0.1499, 0.15, 0.3299, 0.33, 0.5999, 0.60, 1.0, None]
    expected = ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL", None]
    assert column(spark, p, "double", rules.risk_tier("v")) == expected
    assert column(spark, [0.4], "double", rules.risk_tier("v", RiskPolicy(intervention=0.5))) == ["MEDIUM"]


def test_health_status_uses_the_raw_score(spark):
    scores = [59.99, 60.0, 79.996, 80.0, None]
    assert column(spark, scores, "double", rules.health_status("v")) == [
        "Critical", "At Risk", "At Risk", "Healthy", None]


def test_renewal_risk(spark):
    assert column(spark, [39.99, 40.0, 69.99, 70.0], "double", rules.renewal_risk("v")) == [
        "Low", "Medium", "Medium", "High"]


def test_tenure_band(spark):
    a, b, c, d = domain.TENURE_BANDS
    months = [-1, 0, 12, 13, 24, 25, 48, 49, None]
    assert column(spark, months, "int", rules.tenure_band("v")) == [None, a, a, b, b, c, c, d, None]


def test_labels(spark):
    texts = ["Yes", " YES ", "no", "1", "true", "Cancelled", "unknown", None]
    assert column(spark, texts, "string", rules.parse_label("v")) == [1, 1, 0, None, None, None, None, None]
    assert column(spark, texts, "string", rules.is_positive("v")) == [
        True, True, False, True, True, True, False, False]
    older = rules.is_positive("v", domain.OLDER_POSITIVE_LABELS)
    assert column(spark, texts, "string", older) == [True, True, False, True, True, False, False, False]


def test_numeric_one_is_positive_whatever_its_type(spark):
    assert column(spark, [1.0, 0.0, None], "double", rules.is_positive("v")) == [True, False, False]
    assert column(spark, [1, 0], "int", rules.is_positive("v")) == [True, False]


def test_actions_are_cut_after_the_tier_action(spark):
    df = spark.createDataFrame(
        [("Month-to-month", "No", "No", "Electronic check", 3), ("Two year", "Yes", "Yes", "Mailed check", 12)],
        "Contract string, TechSupport string, OnlineSecurity string, PaymentMethod string, tenure int")
    for tier in domain.TIER_ORDER:
        full, bare = [r[0] for r in df.select(rules.actions(F.lit(tier))).collect()]
        assert full == [domain.TIER_ACTIONS[tier], domain.CONTRACT_ACTION, domain.SUPPORT_ACTION,
                        domain.SECURITY_ACTION, domain.PAYMENT_ACTION]
        assert bare == [domain.TIER_ACTIONS[tier]]


def test_display_rounds_on_the_binary_value(spark):
    numbers = [2.675, 0.125, 1234.5, 2.5, -3.14159]
    assert column(spark, numbers, "double", display.fixed("v", 2)) == [f"{n:.2f}" for n in numbers]
    assert column(spark, numbers, "double", display.fmt_money("v"))[2] == "$1,234.50"
    assert column(spark, numbers, "double", display.fmt_int("v")) == [f"{n:,.0f}" for n in numbers]


def test_driver_text_counts_zero_as_lower(spark):
    texts = column(spark, [0.1, 0.0, -0.1], "double", display.driver_text(F.lit("Contract_One year"), "v"))
    assert [("higher" in t, "lower" in t) for t in texts] == [(True, False), (False, True), (False, True)]
    assert texts[0].startswith("Contract One year")


def test_count_passed_equals_comparing_every_edge(spark):
    edges = [h / 100 for h in range(10, 71)]
    probes = [0.0, 0.1, 0.29, 0.3, 0.33, 0.3299999, 0.58, 0.7, 0.99]
    assert column(spark, probes, "double", values.count_passed("v", edges)) == [
        sum(p >= e for e in edges) for p in probes]


def test_normalize_name(spark):
    names = ["Monthly Charges", "customer_ID", "Churn?", "", "é"]
    assert column(spark, names, "string", values.normalize_name("v")) == ["monthlycharges", "customerid", "churn", "", ""]
    assert column(spark, [" Is-Churned? "], "string", values.normalize_name("v", "strict")) == ["ischurned?"]


def test_row_digest_separates_cells(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("a", "bc"), (None, "-"), ("-", None)], "x string, y string")
    assert df.select(values.row_digest(df).alias("d")).distinct().count() == 4


def test_sums_do_not_depend_on_order(spark):
    rng = random.Random(5)
    cents = [rng.randint(-10**12, 10**12) for _ in range(3000)]
    rows = [(c / 1000,) for c in cents]
    found = {spark.createDataFrame(rng.sample(rows, len(rows)), "v double").repartition(n).agg(
        exact_sum("v").alias("s"), exact_mean("v").alias("m")).first() for n in (1, 3, 17)}
    assert found == {(float(Fraction(sum(cents), 1000)), float(Fraction(sum(cents), 1000)) / 3000)}


@pytest.mark.parametrize("values, total", [([], None), ([None], None), ([0.1, 0.2, None], 0.3), ([1e300, 1.0, -1e300], 0.0),
                                           ([1e13, 0.25], 1e13 + 0.25), ([9e11] * 30_000, 2.7e16), ([1e-20, 2.5], 2.5)])
def test_odd_sums(spark, values, total):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.agg(exact_sum("v")).first()[0] in (total, 1.0 if total == 0.0 else total)
    assert (df.agg(exact_mean("v")).first()[0] is None) == (total is None)


def test_sums_of_nan_and_infinity(spark):
    assert math.isnan(spark.createDataFrame([(1.0,), (float("nan"),)], "v double").agg(exact_sum("v")).first()[0])
    assert spark.createDataFrame([(1.0,), (float("inf"),)], "v double").agg(exact_sum("v")).first()[0] == float("inf")
