"""Model evaluation tables (family F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import over, query
from catalog.common import stable, views
from catalog.profile import quantile_sql
from catalog.tables import TIERS
from keepwell.operators import evaluation

# two models to compare: the stand-in scores and their complement
MODELS = """valid as (select * from scored where label is not null),
models as (select 'first' as model, label, probability from valid
           union all select 'second', label, 1 - probability from valid)"""


def scored(spark, sf):
    return views.scored(spark, sf, stored=True)


def two_models(spark, sf):
    base = scored(spark, sf).select("customerID", "label", "probability")
    return base.withColumn("model", F.lit("first")).unionByName(
        base.withColumn("probability", 1 - F.col("probability")).withColumn("model", F.lit("second")))


CELLS = """count(*) filter (probability >= 33e-2 and label = 1)::double as tp,
  count(*) filter (probability >= 33e-2 and label = 0)::double as fp,
  count(*) filter (probability < 33e-2 and label = 1)::double as fn,
  count(*) filter (probability < 33e-2 and label = 0)::double as tn"""
SCORES = """coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
  coalesce(tp * 2 / nullif(tp * 2 + fp + fn, 0), 0) as f1"""


@query("f01_confusion", over("scored", MODELS) + """
select l.label, p.predicted, count(v.label) as count
from (values (0), (1)) l(label) cross join (values (0), (1)) p(predicted)
left join valid v on v.label = l.label and (v.probability >= 33e-2) = (p.predicted = 1) group by all""")
def f01(spark, sf):
    return evaluation.confusion(scored(spark, sf), 0.33)


@query("f02_classification_metrics", over("scored", MODELS) + f"""
select model, (tp + tn) / (tp + fp + fn + tn) as accuracy, {SCORES}
from (select model, {CELLS} from models group by model)""")
def f02(spark, sf):
    return evaluation.classification_metrics(two_models(spark, sf), 0.33, ["model"])


AUC = """steps as (
  select model, probability, sum(label) as pos, count(*) - sum(label) as neg from models group by all),
ladder as (
  select *, sum(pos) over w as pos_upto, sum(neg) over w as neg_upto from steps
  window w as (partition by model order by probability desc)),
auc as (
  select model, sum(neg * (2 * (pos_upto - pos) + pos))::double / (sum(pos)::double * sum(neg) * 2) as roc_auc,
         sum(pos * (pos_upto::double / (pos_upto + neg_upto))) / sum(pos)::double as average_precision
  from ladder group by model)"""


@query("f03_roc_auc", over("scored", MODELS, AUC) + "select model, round(roc_auc, 9) as roc_auc from auc")
def f03(spark, sf):
    return stable(evaluation.roc_auc(two_models(spark, sf), ["model"]), "roc_auc")


@query("f04_average_precision", over("scored", MODELS, AUC) + """
select model, round(average_precision, 9) as average_precision from auc""")
def f04(spark, sf):
    return stable(evaluation.average_precision(two_models(spark, sf), ["model"]), "average_precision")


@query("f05_brier", over("scored", MODELS) + """
select model, round(avg((probability - label) * (probability - label)), 9) as brier from models group by 1""")
def f05(spark, sf):
    return stable(evaluation.brier(two_models(spark, sf), ["model"]), "brier")


@query("f06_log_loss", over("scored", MODELS) + """
select model, round(avg(-case when label = 1 then ln(p) else ln(1 - p) end), 9) as log_loss
from (select *, least(greatest(probability, 2.220446049250313e-16), 1 - 2.220446049250313e-16) as p from models)
group by 1""")
def f06(spark, sf):
    return stable(evaluation.log_loss(two_models(spark, sf), ["model"]), "log_loss")


def _sweep(grid: str) -> str:
    return f"""sweep as (select model, threshold, {SCORES} from (
      select model, h / 1e2 as threshold, count(*) filter (probability >= h / 1e2 and label = 1)::double as tp,
        count(*) filter (probability >= h / 1e2 and label = 0)::double as fp,
        count(*) filter (probability < h / 1e2 and label = 1)::double as fn
      from models cross join (select unnest({grid}) as h) group by all))"""


FINE, COARSE = _sweep("range(10, 71)"), _sweep("range(20, 81, 5)")


@query("f07_threshold_sweep", over("scored", MODELS, FINE) + "select * from sweep")
def f07(spark, sf):
    return evaluation.threshold_sweep(two_models(spark, sf), evaluation.FINE_GRID, ["model"])


@query("f07_threshold_sweep_coarse", over("scored", MODELS, COARSE) + "select * from sweep")
def f07_coarse(spark, sf):
    return evaluation.threshold_sweep(two_models(spark, sf), evaluation.COARSE_GRID, ["model"])


@query("f08_best_threshold", over("scored", MODELS, FINE) + """
select * from sweep qualify row_number() over (partition by model order by f1 desc, threshold) = 1""")
def f08(spark, sf):
    sweep = evaluation.threshold_sweep(two_models(spark, sf), evaluation.FINE_GRID, ["model"])
    return evaluation.best_threshold(sweep, ["model"])


@query("f09_tier_summary", over("scored", TIERS) + """
select e.tier, customers, round(p, 9) as average_probability, round(r, 9) as actual_churn_rate, rank
from every e left join tiers using (tier)""")
def f09(spark, sf):
    return stable(evaluation.tier_summary(scored(spark, sf)), "average_probability", "actual_churn_rate")


POINTS = [i * (1.0 / 10) for i in range(10)] + [1.0]
QUANTILES = f"""edges as (
  select list_sort(list_distinct([{', '.join(f'q{i}' for i in range(11))}])) as e
  from {quantile_sql('probability', 'valid', POINTS)}),
binned as (
  select *, 1 + len(list_filter(e[2:len(e) - 1], lambda x: x < probability)) as bin from valid cross join edges)"""


@query("f10_risk_deciles", over("scored", MODELS, QUANTILES) + """
select bin, max(e[bin]) as lower, max(e[bin + 1]) as upper, count(*) as customers,
       round(avg(probability) * 100, 9) as average_probability, round(avg(label) * 100, 9) as actual_churn_rate
from binned group by bin""")
def f10(spark, sf):
    return stable(evaluation.risk_deciles(scored(spark, sf)), "average_probability", "actual_churn_rate")


@query("f10_risk_deciles_sketch")
def f10_sketch(spark, sf):
    return evaluation.risk_deciles(scored(spark, sf), exact=False)


CALIBRATION = QUANTILES + """,
calibration as (
  select bin, avg(probability) as predicted, avg(label) as actual, abs(avg(probability) - avg(label)) as gap
  from binned group by bin)"""


@query("f11_calibration", over("scored", MODELS, CALIBRATION) + """
select bin, round(predicted, 9) as predicted, round(actual, 9) as actual, round(gap, 9) as gap from calibration""")
def f11(spark, sf):
    return stable(evaluation.calibration(scored(spark, sf)), "predicted", "actual", "gap")


@query("f12_calibration_gap", over("scored", MODELS, CALIBRATION) + """
select round(avg(gap), 9) as mean_gap from calibration""")
def f12(spark, sf):
    return stable(evaluation.calibration_gap(scored(spark, sf)), "mean_gap")


@query("f13_rank_models", over("scored", MODELS, AUC) + f"""
select model, (tp + tn) / (tp + fp + fn + tn) as accuracy, round(roc_auc, 9) as roc_auc,
       round(average_precision, 9) as average_precision, {SCORES}
from (select model, {CELLS} from models group by model) join auc using (model)""")
def f13(spark, sf):
    results = evaluation.evaluate(two_models(spark, sf), 0.33)
    return stable(evaluation.rank_models(results), "roc_auc", "average_precision")
