"""Selection, profiling, portfolio and comparison on small tables."""

import random

import numpy as np
import pandas as pd
import pytest

from keepwell import domain
from keepwell.operators import comparison, pairwise, portfolio, profiling, selection
from tests.conftest import one

CUSTOMER = "name string, usage double, tickets int, nps int, renewal_status string"


def test_validation_reports_every_reason(spark):
    df = spark.createDataFrame([
        (" Ann ", 0.0, 0, 10, "Likely"), ("  ", 101.0, -1, 11, "Maybe"), (None, None, None, None, None)], CUSTOMER)
    valid, rejected = selection.validate_customers(df)
    assert one(valid)["name"] == "Ann"
    assert [len(r["reasons"]) for r in rejected.collect()] == [5, 5]


def test_search_null_never_matches(spark):
    df = spark.createDataFrame([("Acme (EU)",), ("beta",), (None,)], "name string")
    assert selection.search(df, "name", "ACME").count() == 1
    assert selection.search(df, "name", "(eu)", literal=True).count() == 1
    assert selection.search(df, "name", "^b|x$").count() == 1
    assert selection.filter_in(df, "name", []).count() == 3


def test_lookup_keeps_missing_and_repeated_ids(spark):
    df = spark.createDataFrame([("1", "x")], "customerID string, Contract string")
    ids = spark.createDataFrame([(1,), (1,), (2,)], "customerID int")
    found = selection.lookup(df, ids).collect()
    assert sorted((r["requested_id"], r["found"], r["Contract"]) for r in found) == [
        ("1", True, "x"), ("1", True, "x"), ("2", False, None)]


def test_preview_flags_truncation(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    cut = selection.preview(df, ["k"], 4).collect()
    assert [r["k"] for r in cut] == [0, 1, 2, 3] and all(r["truncated"] for r in cut)
    assert not selection.preview(df, ["k"], 10).first()["truncated"]


def test_status_column():
    assert selection.status_column(["a", "status"], {"churn": "c"}) == "status"
    assert selection.status_column(["a"], {"churn": "c"}) == "c"
    assert selection.status_column(["a"], {}) is None


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), rng.choice([1.0, 2.0, 0.0, -0.0, None]), 7, rng.randint(0, 3))
            for _ in range(300)] + [("x", 1.0, 7, 1)] * 150
    frame = pd.DataFrame(rows, columns=["a", "b", "c", "d"])
    return spark.createDataFrame(rows, "a string, b double, c int, d int"), frame


def test_overview_counts_like_pandas(mixed):
    df, frame = mixed
    row = one(profiling.overview(df))
    assert row["rows"] == len(frame) and row["columns"] == 4
    assert row["missing_values"] == int(frame.isna().sum().sum())
    assert row["duplicate_rows"] == int(frame.duplicated().sum())


def test_profile_counts_like_pandas(mixed):
    df, frame = mixed
    for r in profiling.profile(df.select("a", "c", "d")).collect():
        assert r["missing"] == int(frame[r["column"]].isna().sum())
        assert r["unique"] == frame[r["column"]].nunique()
    sketch = {r["column"]: r["unique"] for r in profiling.profile(df, exact=False).collect()}
    assert sketch["d"] == 4


def test_constant_column_has_no_correlation(mixed):
    df, frame = mixed
    found = {(r["first"], r["second"]): r["correlation"] for r in profiling.correlations(df).collect()}
    assert found[("b", "c")] is None
    assert found[("b", "d")] == pytest.approx(frame["b"].corr(frame["d"]))


def test_histogram_covers_every_row(mixed):
    df, frame = mixed
    bars = profiling.histogram(df, "d", 5).collect()
    assert sum(r["count"] for r in bars) == len(frame) and len(bars) == 5
    expected, _ = np.histogram(frame["d"], bins=5)
    assert [r["count"] for r in bars] == expected.tolist()
    constant = profiling.histogram(df, "c", 5).collect()
    assert [r["count"] for r in constant] == [len(frame), 0, 0, 0, 0]


def test_box_whiskers_and_outliers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [*range(1, 12), 100, -50]], "g string, v double")
    row = one(profiling.box_stats(df, "v", "g"))
    assert (row["lower_whisker"], row["upper_whisker"], row["outliers"]) == (1.0, 11.0, 2)
    assert sorted(r["value"] for r in profiling.outliers(df, "v", "v", "g").collect()) == [-50.0, 100.0]


def test_breakdowns_equal_the_single_reports(spark):
    rng = random.Random(5)
    rows = [(f"c{i}" if i % 9 else None, rng.choice([*domain.CONTRACT_ORDER, None]), rng.choice(["m", "n", None]),
             rng.choice(["DSL", "No"]), rng.choice([-1, 3, 12, 13, 30, 70, None]), rng.choice([0, 1, None]))
            for i in range(400)]
    df = spark.createDataFrame(rows, "customerID string, Contract string, PaymentMethod string, InternetService string,"
                                     " tenure int, label int")
    together = {(r["dimension"], r["value"]): (r["customers"], r["churn_rate"])
                for r in portfolio.churn_breakdowns(df).collect()}
    single = {}
    for name in ("Contract", "PaymentMethod", "InternetService"):
        for r in portfolio.churn_by(df, name).collect():
            single[(name, r[name])] = (r["customers"], r["churn_rate"])
    for r in portfolio.segment_summary(df).collect():
        single[("Tenure Band", r["segment"])] = (r["customer_count"], r["churn_rate"])
    assert together == single


ACCOUNT = ("customerID string, tenure int, Contract string, MonthlyCharges double, TotalCharges double, "
           "InternetService string, PaymentMethod string, TechSupport string, OnlineSecurity string, "
           "PaperlessBilling string, Churn string, probability double")


@pytest.fixture(scope="module")
def pair_frames(spark):
    scored = spark.createDataFrame([
        ("A", 5, "One year", 20.0, 100.0, "DSL", "Mailed check", "No", "No", "Yes", "No", 0.40),
        ("B", 9, "Two year", 30.0, None, "DSL", "Mailed check", "No", "Yes", "Yes", None, 0.10),
        ("C", 5, "One year", None, 100.0, "DSL", "Mailed check", "No", "No", "Yes", "No", 0.40),
    ], ACCOUNT)
    pairs = spark.createDataFrame([("A", "B"), ("A", "A"), ("A", "Z"), ("A", "C")], "a string, b string")
    return scored, pairs


def test_pairs_that_cannot_be_compared_are_reported(pair_frames):
    status = {(r["a"], r["b"]): r["status"] for r in comparison.pair_status(*pair_frames).collect()}
    assert status == {("A", "B"): "compared", ("A", "A"): "same customer", ("A", "Z"): "not found",
                      ("A", "C"): "compared"}


def test_differences_and_takeaway(pair_frames):
    texts = {}
    for r in comparison.customer_differences(*pair_frames).orderBy("position").collect():
        texts.setdefault(r["b"], []).append(r["difference"])
    assert texts["B"] == [
        "Customer A has shorter tenure than Customer B.", "Customer B has higher monthly charges.",
        "The customers differ in contract: Customer A has One year, while Customer B has Two year.",
        "The customers differ in Online Security: Customer A has No, while Customer B has Yes.",
        "Customer A has the higher predicted churn probability."]
    assert "C" not in texts  # NULL charges say nothing, everything else is equal
    takeaway = {r["b"]: r["takeaway"] for r in comparison.comparison_takeaway(*pair_frames).collect()}
    assert "30.0 percentage points higher" in takeaway["B"]
    assert takeaway["C"] == "Customer A and Customer B have the same predicted churn probability."


def test_comparison_has_fourteen_rows(pair_frames):
    rows = comparison.compare_customers(*pair_frames).where("b = 'B'").orderBy("position").collect()
    shown = {r["metric"]: (r["customer_a"], r["customer_b"]) for r in rows}
    assert len(rows) == 14
    assert shown["Tenure"] == ("5 months", "9 months")
    assert shown["Total Charges"] == ("$100.00", "Not available")
    assert shown["Risk Tier"] == ("HIGH", "LOW")
    assert shown["Actual Churn"] == ("No", "Not available")


@pytest.mark.parametrize("block, rows", [(32, 20_000), (3, 20), (1, 7)])
def test_correlations_of_columns_with_gaps(spark, monkeypatch, block, rows):
    """Complete pairs as pandas takes them; offsets far from zero, constants, empty columns and columns of one value."""
    monkeypatch.setattr(pairwise, "ROWS", rows)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) * 10.0 ** np.arange(-3, 4) + [0, 1e9, -5, 0, 1e6, 0, 3]
    x[rng.random(x.shape) < 0.3] = np.nan
    frame = pd.DataFrame(x, columns=[f"c {k}" for k in range(7)])
    frame["same"], frame["none"], frame["once"] = 0.1, np.nan, [5.0] + [np.nan] * 299
    frame["late"] = [np.nan] * 200 + [0.1] * 50 + [7.3] * 50
    df = spark.createDataFrame([tuple(r) for r in frame.to_numpy().tolist()], ", ".join(f"`{c}` double" for c in frame))
    want = (frame - frame.median()).corr()
    found = pairwise.correlation_table(df.repartition(5), df.columns, block).collect()
    assert len(found) == len({(r["i"], r["j"]) for r in found}) == 11 * 10 // 2
    for r in found:
        expected = want.iloc[r["i"], r["j"]]
        if np.isnan(expected) or "same" in (df.columns[r["i"]], df.columns[r["j"]]):
            assert r["correlation"] is None
        else:
            assert r["correlation"] == pytest.approx(expected, abs=1e-9)


def test_correlations_of_an_empty_table_and_infinities(spark):
    empty = spark.createDataFrame([], "a double, b int, c decimal(9,2)")
    assert [(r["first"], r["second"], r["correlation"]) for r in profiling.correlations(empty).orderBy("i", "j").collect()] == [
        ("a", "b", None), ("a", "c", None), ("b", "c", None)]
    odd = spark.createDataFrame([(1.0, 2.0, float("inf")), (2.0, 4.5, 1.0), (3.0, 6.0, 2.0)], "a double, b double, c double")
    found = {(r["i"], r["j"]): r["correlation"] for r in profiling.correlations(odd).collect()}
    assert found[0, 1] == pytest.approx(0.989743318610787) and found[0, 2] is None and found[1, 2] is None
    assert profiling.strongest_pair(odd).first()["first"] == "a"
    assert profiling.correlations(odd.select("a")).count() == 0


def test_no_tenure_is_shorter_than_a_missing_one(spark):
    names = "customerID string, tenure long, MonthlyCharges double, Contract string, InternetService string, PaymentMethod string, " \
        "TechSupport string, OnlineSecurity string, PaperlessBilling string, TotalCharges double, Churn string, probability double"
    rows = [(k, t, 1.0, *["x"] * 6, 2.0, "No", 0.5) for k, t in (("A", 5), ("B", None), ("C", 9))]
    pairs = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "C")], "a string, b string")
    found = comparison.customer_differences(spark.createDataFrame(rows, names), pairs).collect()
    assert [(r["a"], r["b"], r["difference"]) for r in found] == [("A", "C", "Customer A has shorter tenure than Customer B.")]


def test_profile_counts_long_texts_by_digest(spark):
    long = "x" * 5000
    rows = [(long + "1",), (long + "2",), (long + "1",), (None,), ("x" * 32,), ("x" * 33,)]
    row = profiling.profile(spark.createDataFrame(rows, "t string")).first()
    assert (row["missing"], row["unique"]) == (1, 4)
