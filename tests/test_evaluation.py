"""Evaluation tables against brute force, pandas and Spark's own evaluator."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from keepwell.operators import evaluation
from tests.conftest import one


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    rows = [(rng.choice([0, 1]), round(rng.random(), 2)) for _ in range(300)]
    return rows + [(1, 0.5)] * 60 + [(0, 0.5)] * 90 + [(0, 0.0), (1, 1.0)]


@pytest.fixture(scope="module")
def scored(spark, data):
    return spark.createDataFrame(data + [(None, 0.3)], "label int, probability double")


def test_auc_counts_pairs(data, scored):
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert one(evaluation.roc_auc(scored))["roc_auc"] == pytest.approx(pairs / len(pos) / len(neg), abs=1e-12)


def test_auc_equals_the_evaluator(scored):
    theirs = BinaryClassificationEvaluator(rawPredictionCol="probability", numBins=0).evaluate(
        scored.dropna().selectExpr("cast(label as double) label", "probability"))
    assert one(evaluation.roc_auc(scored))["roc_auc"] == pytest.approx(theirs, abs=1e-9)


def test_average_precision_is_stepwise(data, scored):
    total, area, seen = sum(y for y, _ in data), 0.0, 0.0
    for cut in sorted({p for _, p in data}, reverse=True):
        above = [y for y, p in data if p >= cut]
        recall = sum(above) / total
        area += (recall - seen) * sum(above) / len(above)
        seen = recall
    assert one(evaluation.average_precision(scored))["average_precision"] == pytest.approx(area, abs=1e-12)


def test_one_class_only_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "label int, probability double")
    assert one(evaluation.roc_auc(df))["roc_auc"] is None


def test_sweep_equals_metrics_at_each_threshold(scored):
    sweep = evaluation.threshold_sweep(scored, evaluation.COARSE_GRID).orderBy("threshold").collect()
    assert len(sweep) == 13
    for row in (sweep[0], sweep[6], sweep[12]):
        single = one(evaluation.classification_metrics(scored, row["threshold"]))
        assert [row[m] for m in ("precision", "recall", "f1")] == [single[m] for m in ("precision", "recall", "f1")]


def test_best_threshold_takes_the_first_maximum(spark):
    sweep = spark.createDataFrame([(0.1, 0.5, 0.5, 0.5), (0.2, 0.4, 0.9, 0.7), (0.3, 0.9, 0.4, 0.7)],
                                  "threshold double, precision double, recall double, f1 double")
    assert one(evaluation.best_threshold(sweep))["threshold"] == 0.2


def test_nothing_predicted_scores_zero(spark):
    df = spark.createDataFrame([(1, 0.2), (0, 0.1)], "label int, probability double")
    row = one(evaluation.classification_metrics(df, 0.9))
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_confusion_has_four_cells(spark):
    df = spark.createDataFrame([(1, 0.2)], "label int, probability double")
    assert {(r["label"], r["predicted"]): r["count"] for r in evaluation.confusion(df).collect()} == {
        (0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_deciles_equal_qcut(data, scored):
    frame = pd.DataFrame(data, columns=["y", "p"])
    bins, edges = pd.qcut(frame["p"], 10, duplicates="drop", retbins=True)
    expected = frame.groupby(bins.cat.codes).agg(n=("y", "size"), p=("p", "mean"), y=("y", "mean"))
    mine = evaluation.risk_deciles(scored).collect()
    assert [r["customers"] for r in mine] == expected["n"].tolist()
    assert [r["lower"] for r in mine] + [mine[-1]["upper"]] == edges.tolist()
    assert np.allclose([r["actual_churn_rate"] for r in mine], expected["y"] * 100)


def test_equal_scores_share_one_bin(spark):
    df = spark.createDataFrame([(i % 2, 0.4) for i in range(20)], "label int, probability double")
    row = one(evaluation.risk_deciles(df))
    assert (row["bin"], row["lower"], row["upper"], row["customers"]) == (1, 0.4, 0.4, 20)


def test_calibration_gap(data, scored):
    table = evaluation.calibration(scored).collect()
    assert one(evaluation.calibration_gap(scored))["mean_gap"] == pytest.approx(np.mean([r["gap"] for r in table]))


def test_probability_metrics(data, scored):
    y, p = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    row = one(evaluation.probability_metrics(scored))
    clipped = np.clip(p, evaluation.SMALLEST, 1 - evaluation.SMALLEST)
    assert row["brier"] == pytest.approx(np.mean((p - y) ** 2))
    assert row["log_loss"] == pytest.approx(-np.mean(np.where(y == 1, np.log(clipped), np.log(1 - clipped))))


def test_empty_tiers_stay(spark):
    df = spark.createDataFrame([(1, 0.2)], "label int, probability double")
    assert [(r["tier"], r["customers"]) for r in evaluation.tier_summary(df).collect()] == [
        ("LOW", None), ("MEDIUM", 1), ("HIGH", None), ("CRITICAL", None)]
