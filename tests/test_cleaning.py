"""Cleaning, column kinds and role detection."""

import pytest

from keepwell.operators import cleaning, roles


@pytest.fixture(scope="module")
def dirty(spark):
    rows = []
    for i in range(100):
        rows.append((
            f" C{i % 99} ",                                  # one repeated id
            str(i) if i < 80 else "n/a",                     # exactly 80 % numeric
            f" {i} " if i < 79 else "1d",                    # 79 % numeric
            None, "same", 5.0))
    rows.append(rows[0])
    return spark.createDataFrame(
        rows[:100], "` Customer ID ` string, `Monthly Charges` string, note string, empty string, `note ` string, c double")


def test_clean_frame_promotes_from_eighty_percent(dirty):
    df = cleaning.clean_frame(dirty)
    assert df.columns == ["Customer ID", "Monthly Charges", "note", "empty", "note_2", "c"]
    assert dict(df.dtypes)["Monthly Charges"] == "double"
    assert dict(df.dtypes)["note"] == "string"
    assert dict(df.dtypes)["empty"] == "string"
    row = df.where("`Monthly Charges` = 5").first()
    assert row["Customer ID"] == "C5" and row["note"] == "5"
    assert df.where("`Monthly Charges` is null").count() == 20


def test_clean_frame_is_idempotent(dirty):
    once = cleaning.clean_frame(dirty)
    twice = cleaning.clean_frame(once)
    assert twice.schema == once.schema
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_names_with_dots_and_repeats(spark):
    df = spark.createDataFrame([("1", "2", "x")], ["a.b ", " a.b", "`q`"])
    clean = cleaning.clean_frame(df)
    assert clean.columns == ["a.b", "a.b_2", "`q`"]
    assert clean.first()[0] == 1.0


def test_empty_frame_promotes_nothing(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert cleaning.clean_frame(df).dtypes == [("a", "string"), ("b", "int")]


def test_booleans_are_categories(spark):
    df = spark.createDataFrame([(True, 1, 1.5, "x")], "a boolean, b int, c double, d string")
    assert cleaning.column_kinds(df) == {"a": "categorical", "b": "numeric", "c": "numeric", "d": "categorical"}


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], ["tenure"])
    with pytest.raises(ValueError, match="Churn, Contract"):
        cleaning.require_columns(df, ["tenure", "Contract", "Churn"])


def _roles(spark, names, mode="fuzzy"):
    rows = [("t", i, n) for i, n in enumerate(names)]
    found = roles.detect_roles(spark.createDataFrame(rows, roles.HEADINGS), mode)
    return {r["role"]: r["column"] for r in found.collect()}


def test_exact_alias_beats_an_earlier_partial_match(spark):
    assert _roles(spark, ["customer segment", "Account_ID"])["customer_id"] == "Account_ID"


def test_partial_matches_go_both_ways(spark):
    found = _roles(spark, ["id", "carrier", "Monthly Charges (USD)", "???"])
    assert found["customer_id"] == "id"          # contained in `customerid`
    assert found["revenue"] == "carrier"         # contains `arr`
    assert "???" not in found.values()           # normalises to nothing


def test_a_one_letter_name_matches_every_role_holding_the_letter(spark):
    assert set(_roles(spark, ["a"])) == set(roles.domain.ROLE_ALIASES)


def test_exact_mode(spark):
    found = _roles(spark, ["Customer_ID", "customer-id", "Is Churned", "usage_score"], "exact")
    assert found == {"customer_id": "customer-id", "churn": "Is Churned"}


def test_overrides(spark):
    detected = {"revenue": "mrr", "churn": "left"}
    assert roles.resolve_roles(detected, {"churn": None}, ["mrr", "left"]) == {"revenue": "mrr", "churn": None}
    with pytest.raises(ValueError, match="nope"):
        roles.resolve_roles(detected, {"churn": "nope"}, ["mrr", "left"])


def test_role_report_names_what_is_missing(spark):
    headings = spark.createDataFrame([("t", 0, "Contract")], roles.HEADINGS)
    report = {r["role"]: r["column"] for r in roles.role_report(roles.detect_roles(headings), headings).collect()}
    assert len(report) == 8 and report["contract"] == "Contract" and report["usage"] == "Not detected"
