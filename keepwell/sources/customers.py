"""The store of customer-success accounts: one for records that are loaded, appended and streamed.

Every batch of records has a name. Its accepted and rejected records are written together, under that name, so the input
is evaluated once; then a row of the log says that the batch is whole and which ids it took. Only logged batches are read.
A batch that is given again under the same name (a stream's batch after a restart) replaces what a lost driver left
behind, or, if it is in the log, is left alone.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell.domain import CUSTOMER_SCHEMA, STORED_CUSTOMER_SCHEMA
from keepwell.operators.selection import checked_customers

LOG = "batch string, first long, last long, accepted long, rejected long"
PARTITIONS = [T.StructField("outcome", T.StringType()), T.StructField("batch", T.StringType())]
RECORDS = T.StructType([*STORED_CUSTOMER_SCHEMA.fields, T.StructField("reasons", T.ArrayType(T.StringType())), *PARTITIONS])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(batch, first, last, accepted, rejected): a short row for each batch; none, if there is no store yet."""
    try:
        return spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{path}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def _records(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    # rows of unfinished batches are not in the log
    stored = spark.read.schema(RECORDS).option("basePath", f"{path}/records").parquet(f"{path}/records")
    return stored.where(F.col("outcome") == outcome).join(read_log(spark, path).select("batch"), "batch", "left_semi")


def load_customers(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path, "accepted").select(*STORED_CUSTOMER_SCHEMA.fieldNames())


def rejected_customers(spark: SparkSession, path: str, batch: str | None = None) -> DataFrame:
    """Rejected records with their reasons, of all batches or one."""
    found = _records(spark, path, "rejected")
    if batch is not None:
        found = found.where(F.col("batch") == batch)
    return found.select(*CUSTOMER_SCHEMA.fieldNames(), "reasons")


def save_customers(df: DataFrame, path: str) -> None:
    """Makes a whole table that already has ids the content of the store; what it held goes."""
    fields = [F.col(f.name).cast(f.dataType) for f in STORED_CUSTOMER_SCHEMA.fields]
    rows = df.select(*fields, F.lit(None).cast("array<string>").alias("reasons"), F.lit("accepted").alias("outcome"))
    _write(rows, path, "whole", replace=True)


def next_id(spark: SparkSession, path: str) -> int:
    """One above the largest stored id, from the log alone."""
    largest = read_log(spark, path).agg(F.max("last").alias("id")).first()["id"]
    return 1 if largest is None else largest + 1


def append_customers(new: DataFrame, path: str, batch: str | None = None) -> DataFrame:
    """Appends the valid records and returns the rejected ones with their reasons.

    The store gives ids: unique and above every stored id, not dense. A `batch` that the store has already taken adds
    nothing. One writer at a time.
    """
    spark, batch = new.sparkSession, batch or f"append-{uuid.uuid4().hex}"
    if read_log(spark, path).where(F.col("batch") == batch).isEmpty():
        first = next_id(spark, path)
        accepted = F.size("reasons") == 0
        rows = checked_customers(new.select(*CUSTOMER_SCHEMA.fieldNames())).select(
            F.when(accepted, F.lit(first) + F.monotonically_increasing_id()).alias("id"),
            *[F.col(f.name).cast(f.dataType) for f in CUSTOMER_SCHEMA.fields], "reasons",
            F.when(accepted, F.lit("accepted")).otherwise(F.lit("rejected")).alias("outcome"))
        _write(rows, path, batch)
    return rejected_customers(spark, path, batch)


def _write(rows: DataFrame, path: str, batch: str, replace: bool = False) -> None:
    """Writes a batch, then its row of the log. `replace` takes the place of the whole store."""
    spark = rows.sparkSession
    mode = "static" if replace else "dynamic"  # dynamic replaces the batch's own folders only
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(
        "outcome", "batch").parquet(f"{path}/records")
    written = spark.read.schema(RECORDS).parquet(f"{path}/records").where(F.col("batch") == batch)
    taken = written.agg(
        F.lit(batch).alias("batch"), F.min("id").alias("first"), F.max("id").alias("last"),
        F.count_if(F.col("outcome") == "accepted").alias("accepted"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected"))
    log = f"{path}/log" if replace else f"{path}/log/{batch}"
    taken.coalesce(1).write.mode("overwrite").parquet(log)
