"""Customer records arriving as files, validated and stored as a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keepwell.domain import CUSTOMER_SCHEMA, DEFAULT_POLICY, RiskPolicy
from keepwell.plans.scoring import score
from keepwell.sources.champion import Champion
from keepwell.sources.customers import append_customers, load_customers, rejected_customers


def read_customer_stream(spark: SparkSession, source: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(CUSTOMER_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(source)


def stream_customers(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """Takes what has arrived into the customer store, and stops.

    Each micro-batch is a batch of the store, named by the checkpoint and its number, with ids like those of appended
    records. A restart from the checkpoint adds nothing twice: a batch that the store already has is passed over, and one
    that a lost driver left unfinished is written anew.
    """
    name = f"stream-{hashlib.sha256(checkpoint.rstrip('/').encode()).hexdigest()[:16]}"

    def take(records: DataFrame, number: int) -> None:
        append_customers(records, store, f"{name}-{number}")

    return (
        read_customer_stream(spark, source).writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def streamed_customers(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) records stored so far; the folder partition prunes the other kind."""
    return load_customers(spark, store), rejected_customers(spark, store)


def stream_scores(accounts: DataFrame, champion: Champion, sink: str, checkpoint: str,
                  policy: RiskPolicy = DEFAULT_POLICY) -> StreamingQuery:
    """Scores a stream of accounts with the champion; stateless, partitioned by risk tier."""
    return (
        score(accounts, champion, policy).writeStream.format("parquet").partitionBy("risk_tier")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
