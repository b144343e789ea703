"""Reading any table and writing report tables."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell import domain
from keepwell.domain import DEFAULT_POLICY, RiskPolicy
from keepwell.functions.values import quoted, to_number
from keepwell.operators.cleaning import text_columns
from keepwell.sources.csv_records import needs_records, read_records

FORMATS = {".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}
CSV_OPTIONS = {"header": True, "inferSchema": False, "escape": '"', "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}
IMPORTANCE_SCHEMA = "Feature string, Importance double"


def format_of(path: str) -> str:
    """The reader a path asks for by its extension, whatever the case."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in FORMATS:
        raise ValueError(f"No reader for {path!r}; known extensions: {', '.join(sorted(FORMATS))}")
    return FORMATS[extension]


def missing_texts_to_null(df: DataFrame) -> DataFrame:
    """Texts that mean "missing" become NULL in every text column."""
    texts = set(text_columns(df))
    return df.select(*[
        F.when(~quoted(c).isin(domain.NA_TEXTS), quoted(c)).alias(c) if c in texts else quoted(c) for c in df.columns])


def read_table(spark: SparkSession, path: str, fmt: str | None = None, multiline: bool | None = None) -> DataFrame:
    """Any supported table. CSV columns arrive as text, for `clean_frame` to type.

    Big CSV files are split over tasks, also where quoted values hold line breaks; `multiline` says whether any does, and
    by default the text is asked (see `csv_rows`). A row with more values than the header stops the job that reads it, as
    `read_csv_quarantined` would not; a shorter row is filled with NULL.
    """
    fmt = fmt or format_of(path)
    try:
        if fmt in ("csv", "tsv"):
            rows, text, wide = csv_rows(spark, path, "\t" if fmt == "tsv" else ",", multiline)
            refused = F.raise_error(F.concat(F.lit("A row has more values than the header: "), text)).cast("boolean")
            kept = rows.where(F.when(wide, refused).otherwise(F.lit(True)))
            return missing_texts_to_null(kept.drop(TEXT, WIDE))
        return spark.read.format(fmt).load(path)
    except AnalysisException as error:
        raise ValueError(f"Could not read the table {path!r}: {error}") from error


TEXT, WIDE = "_row_as_text", "_row_is_wide"


def csv_rows(spark: SparkSession, path: str, sep: str = ",", multiline: bool | None = None,
             columns: list[str] | None = None) -> tuple[DataFrame, Column, Column]:
    """The rows of CSV files with two more columns: the text of a row of the wrong width, and whether it is too wide.

    Where no line has an odd number of quotes no value goes over a line, and Spark's own reader takes every split by
    itself. Otherwise records are found across lines and splits, see `csv_records`. Every column is parsed whatever is
    selected, since a row's width shows only when all of it is read.
    """
    reader = spark.read.options(**{**CSV_OPTIONS, "sep": sep})
    columns = columns or reader.option("multiLine", True).csv(path).columns
    width = len(columns)
    if multiline if multiline is not None else needs_records(spark, path):
        records = read_records(spark, path, width, sep)
        rows = records.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)], F.col("text").alias(TEXT),
                              (F.size("cells") > width).alias(WIDE))
        return rows, F.col(TEXT), F.col(WIDE)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, TEXT]])
    rows = spark.read.options(**{**CSV_OPTIONS, "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": TEXT,
                                 "columnPruning": False}).schema(schema).csv(path)
    # always true; Spark refuses plans that read nothing but the corrupt-record column, as a bare count would
    rows = rows.where(F.length(F.concat_ws("", *[quoted(c) for c in columns])) >= 0)
    bare = F.regexp_replace(TEXT, '"([^"]|"")*"', "")
    values = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    return rows.withColumn(WIDE, F.col(TEXT).isNotNull() & (values > width)), F.col(TEXT), F.col(WIDE)


def read_csv_quarantined(spark: SparkSession, path: str, columns: list[str] | None = None,
                         multiline: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows of the wrong width with their text in `_corrupt_record`) of a CSV."""
    rows, text, _ = csv_rows(spark, path, ",", multiline, columns)
    good = rows.where(text.isNull()).drop(TEXT, WIDE)
    return missing_texts_to_null(good), rows.where(text.isNotNull()).drop(WIDE).withColumnRenamed(TEXT, "_corrupt_record")


def require_nonempty(df: DataFrame, name: str = "dataset") -> DataFrame:
    """The table itself, or an error when it has no rows (at most one row is looked at)."""
    if df.isEmpty():
        raise ValueError(f"The {name} contains no rows.")
    return df


def write_report(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A table as CSV with a header. Only short reports should ask for a single file."""
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    """A feature-importance report, most important first; an absent or malformed report is an empty table."""
    empty = spark.createDataFrame([], IMPORTANCE_SCHEMA)
    try:
        report = read_table(spark, path, "csv")
    except ValueError:
        return empty
    if not {"Feature", "Importance"}.issubset(report.columns):
        return empty
    return report.select("Feature", to_number("Importance").alias("Importance")).dropna().orderBy(
        F.desc("Importance"), "Feature")


def policy_table(spark: SparkSession, policy: RiskPolicy = DEFAULT_POLICY) -> DataFrame:
    """(tier, lower, upper, probability_range): the tier boundaries in force."""
    low, middle, high = (f"{round(v * 100)}%" for v in (policy.low, policy.intervention, policy.critical))
    rows = [
        ("LOW", 0.0, policy.low, f"< {low}"),
        ("MEDIUM", policy.low, policy.intervention, f"{low}–{middle}"),
        ("HIGH", policy.intervention, policy.critical, f"{middle}–{high}"),
        ("CRITICAL", policy.critical, 1.0, f">= {high}"),
    ]
    return spark.createDataFrame(rows, "tier string, lower double, upper double, probability_range string")


def published_metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(domain.PUBLISHED_METRICS.items()), "metric string, value string")
