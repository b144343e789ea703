"""The older renewal model over usage, tickets and NPS, and its batch scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.domain import SEED
from keepwell.functions import display
from keepwell.functions.rules import health_score, renewal_recommendation, renewal_risk

INPUTS = ["usage", "tickets", "nps"]


def with_renewal_label(customers: DataFrame, healthy: float = 45.0) -> DataFrame:
    """A stand-in outcome: an account renews when its health score reaches `healthy`."""
    renewed = health_score("usage", "nps", "tickets") >= healthy
    return customers.withColumn("renewed", F.when(renewed, 1).when(~renewed, 0))


def train_renewal(labelled: DataFrame, trees: int = 100, depth: int = 30) -> PipelineModel:
    assembler = VectorAssembler(inputCols=INPUTS, outputCol="features", handleInvalid="keep")
    classifier = RandomForestClassifier(featuresCol="features", labelCol="renewed", numTrees=trees, maxDepth=depth,
                                        seed=SEED)
    return Pipeline(stages=[assembler, classifier]).fit(labelled.dropna(subset=[*INPUTS, "renewed"]))


def score_renewal(customers: DataFrame, model: PipelineModel) -> DataFrame:
    """Customers with renewal and churn probabilities in percent (two decimals), risk level and recommendation.

    Every customer has a row; one with a missing input has NULL in all four columns.
    """
    scored = model.transform(customers)
    known = F.lit(True)
    for name in INPUTS:
        known = known & F.col(name).isNotNull()
    p = F.when(known, vector_to_array("probability"))
    return (
        scored.withColumn("renewal_probability", display.rounded(p[1] * 100, 2))
        .withColumn("churn_probability", display.rounded(p[0] * 100, 2))
        .withColumn("risk_level", renewal_risk("churn_probability"))
        .withColumn("recommendation", renewal_recommendation("risk_level"))
        .select(*customers.columns, "renewal_probability", "churn_probability", "risk_level", "recommendation")
    )
