"""Model evaluation as DataFrame algebra over (label, probability), optionally per group (`by`)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell import domain
from keepwell.domain import DEFAULT_POLICY, RiskPolicy
from keepwell.functions.rules import domain_rank, risk_tier
from keepwell.functions.values import count_passed
from keepwell.operators.ordering import quantiles, running_totals

SMALLEST = 2.220446049250313e-16

# thresholds as whole hundredths, divided by 100 where they are compared
COARSE_GRID = range(20, 81, 5)
FINE_GRID = range(10, 71)


def labelled(scored: DataFrame) -> DataFrame:
    """Rows with a label and a probability; NaN is none."""
    return scored.where(F.col("label").isNotNull() & F.col("probability").isNotNull() & ~F.isnan("probability"))


def _counts(threshold: float) -> dict[str, Column]:
    """The four cells of the confusion matrix as aggregates."""
    above, positive = F.col("probability") >= threshold, F.col("label") == 1
    return {
        "tp": F.count_if(above & positive), "fp": F.count_if(above & ~positive),
        "fn": F.count_if(~above & positive), "tn": F.count_if(~above & ~positive),
    }


def _ratio(part: Column, whole: Column) -> Column:
    """Zero when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(tp * 2, tp * 2 + fp + fn)}


def confusion(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, predicted, count): always four cells."""
    cells = labelled(scored).groupBy(*by).agg(*[c.alias(n) for n, c in _counts(threshold).items()])
    rows = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(predicted).alias("predicted"), F.col(name).alias("count"))
        for label, predicted, name in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]])
    return cells.select(*by, F.inline(rows))


def classification_metrics(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(by, accuracy, precision, recall, f1); a division by nothing scores 0."""
    cells = labelled(scored).groupBy(*by).agg(*[c.alias(n) for n, c in _counts(threshold).items()])
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return cells.select(*by, _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                        *[c.alias(n) for n, c in _scores(tp, fp, fn).items()])


def score_ladder(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score with its positives and negatives and those above it. Equal scores are one step."""
    steps = labelled(scored).groupBy(*by, "probability").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    return running_totals(steps, "probability", ["pos", "neg"], by, descending=True)


def ranking_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, roc_auc, average_precision) from one ladder.

    The area counts (positive above negative) pairs, ties half, in exact decimals. Average precision is the stepwise
    sum of recall gain times precision.
    """
    wide = "decimal(38,0)"
    twice_pairs = F.sum(F.col("neg").cast("decimal(19,0)")
                        * (F.col("pos_before") * 2 + F.col("pos")).cast("decimal(19,0)"))
    hits, alarms = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    totals = score_ladder(scored, by).groupBy(*by).agg(
        twice_pairs.cast(wide).alias("twice_pairs"), F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.col("pos") * (hits.cast("double") / (hits + alarms))).alias("gain"))
    pairs = F.col("p").cast("double") * F.col("n").cast("double") * 2
    return totals.select(*by, F.try_divide(F.col("twice_pairs").cast("double"), pairs).alias("roc_auc"),
                         F.try_divide(F.col("gain"), F.col("p").cast("double")).alias("average_precision"))


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(scored, by).select(*by, "roc_auc")


def average_precision(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(scored, by).select(*by, "average_precision")


def _brier() -> Column:
    gap = F.col("probability") - F.col("label")
    return F.avg(gap * gap)


def _log_loss() -> Column:
    p = F.least(F.greatest(F.col("probability"), F.lit(SMALLEST)), F.lit(1 - SMALLEST))
    return F.avg(-F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def brier(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return labelled(scored).groupBy(*by).agg(_brier().alias("brier"))


def log_loss(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return labelled(scored).groupBy(*by).agg(_log_loss().alias("log_loss"))


def probability_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, brier, log_loss) from one pass."""
    return labelled(scored).groupBy(*by).agg(_brier().alias("brier"), _log_loss().alias("log_loss"))


def threshold_sweep(scored: DataFrame, grid: Sequence[int] = FINE_GRID, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, precision, recall, f1) for every threshold, given in whole hundredths.

    Each row is filed under the number of thresholds it reaches, so one pass serves the whole grid; a threshold's
    counts are then sums over the few files at or beyond it.
    """
    grid = sorted(grid)
    edges = [h / 100 for h in grid]
    files = labelled(scored).groupBy(*by, count_passed("probability", edges).alias("passed")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    per_group = files.groupBy(*by).agg(F.collect_list(F.struct("passed", "pos", "neg")).alias("files"))
    rows = per_group.select(*by, "files", F.posexplode(F.array(*[F.lit(e) for e in edges])).alias("i", "threshold"))

    def total(field: str, beyond: bool) -> Column:
        kept = F.filter("files", lambda f: f["passed"] > F.col("i")) if beyond else F.col("files")
        return F.aggregate(kept, F.lit(0).cast("long"), lambda acc, f: acc + f[field])

    cells = rows.select(*by, "threshold", total("pos", True).alias("tp"), total("neg", True).alias("fp"),
                        total("pos", False).alias("p"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("p") - F.col("tp")
    return cells.select(*by, "threshold", *[c.alias(n) for n, c in _scores(tp, fp, fn).items()])


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The row with the highest F1, the lowest threshold on ties."""
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("threshold")))
    return sweep.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def tier_summary(scored: DataFrame, policy: RiskPolicy = DEFAULT_POLICY) -> DataFrame:
    """(tier, customers, average_probability, actual_churn_rate, rank) in percent; empty tiers stay as NULL rows."""
    observed = labelled(scored).groupBy(risk_tier("probability", policy).alias("tier")).agg(
        F.count(F.lit(1)).alias("customers"), (F.avg("probability") * 100).alias("average_probability"),
        (F.avg("label") * 100).alias("actual_churn_rate"))
    tiers = scored.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, domain.TIER_ORDER))).alias("tier"))
    return tiers.join(observed, "tier", "left").withColumn("rank", domain_rank("tier", domain.TIER_ORDER)).orderBy(
        "rank")


def quantile_edges(scored: DataFrame, bins: int, exact: bool = True) -> DataFrame:
    """One row: the distinct quantile edges of the scores, ascending."""
    points = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    table = quantiles(labelled(scored), "probability", points, exact=exact)
    return table.select(F.array_distinct("quantiles").alias("edges"))


def _binned(scored: DataFrame, bins: int, exact: bool) -> DataFrame:
    """Rows with their quantile `bin`, from 1, and its edges; a score equal to an inner edge is in the lower bin."""
    edges = quantile_edges(scored, bins, exact).scalar()
    rows = labelled(scored).select("label", "probability", edges.alias("_edges"))
    last = F.size("_edges") - 1
    passed = [(F.col("probability") > F.get("_edges", F.lit(i))) & (F.lit(i) < last) for i in range(1, bins)]
    number = reduce(lambda a, b: a + b, [F.when(p, 1).otherwise(0) for p in passed], F.lit(1))
    rows = rows.withColumn("bin", number)
    return rows.select("label", "probability", "bin", F.get("_edges", F.col("bin") - 1).alias("lower"),
                       F.get("_edges", F.least(F.col("bin"), last)).alias("upper"))


def risk_deciles(scored: DataFrame, q: int = 10, exact: bool = True) -> DataFrame:
    """(bin, lower, upper, customers, average_probability, actual_churn_rate) per quantile bin, rates in percent.

    Bins are right-closed with the lowest score included; equal edges are merged, so ties share a bin.
    """
    return _binned(scored, q, exact).groupBy("bin", "lower", "upper").agg(
        F.count(F.lit(1)).alias("customers"), (F.avg("probability") * 100).alias("average_probability"),
        (F.avg("label") * 100).alias("actual_churn_rate")).orderBy("bin")


def calibration(scored: DataFrame, bins: int = 10, exact: bool = True) -> DataFrame:
    """(bin, predicted, actual, gap) per quantile bin; empty bins do not appear."""
    table = _binned(scored, bins, exact).groupBy("bin").agg(F.avg("probability").alias("predicted"), F.avg("label").alias("actual"))
    return table.withColumn("gap", F.abs(F.col("predicted") - F.col("actual"))).orderBy("bin")


def calibration_gap(scored: DataFrame, bins: int = 10, exact: bool = True) -> DataFrame:
    return calibration(scored, bins, exact).agg(F.avg("gap").alias("mean_gap"))


def rank_models(results: DataFrame) -> DataFrame:
    """Model results from best to worst by ROC-AUC."""
    return results.orderBy(F.desc("roc_auc"), "model")


def evaluate(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by, accuracy, roc_auc, average_precision, precision, recall, f1) per group."""
    basic = classification_metrics(scored, threshold, by)
    ranked = ranking_metrics(scored, by)
    return basic.join(ranked, list(by)).select(
        *by, "accuracy", "roc_auc", "average_precision", "precision", "recall", "f1")
