"""Cleaning, typing and column kinds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell import domain
from keepwell.functions.rules import parse_label
from keepwell.functions.values import is_number, nan_to_null, quoted, strip, to_number


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError("The table is missing these columns: " + ", ".join(missing))
    return df


def trimmed_names(names: Sequence[str]) -> list[str]:
    """Names without surrounding spaces; a repeated name gets the suffix _2, _3, ..."""
    taken: set[str] = set()
    result = []
    for name in (n.strip() for n in names):
        candidate, copy = name, 1
        while candidate in taken:
            copy += 1
            candidate = f"{name}_{copy}"
        taken.add(candidate)
        result.append(candidate)
    return result


def trim_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*trimmed_names(df.columns))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Every column that is not a number; a boolean is a category."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def column_kinds(df: DataFrame) -> dict[str, str]:
    numeric = set(numeric_columns(df))
    return {name: "numeric" if name in numeric else "categorical" for name in df.columns}


def long_form(df: DataFrame, columns: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """One (column, value-as-text) row per cell."""
    cells = df.select(*[quoted(c).cast("string").alias(c) for c in columns])
    return cells.unpivot([], [quoted(c) for c in columns], name, value)


def numeric_ratios(df: DataFrame, ratio: float = 0.80) -> DataFrame:
    """For every text column, the share of all rows that spell a number, from one aggregate over the table."""
    columns = text_columns(df)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_number(quoted(c))).alias(f"c{i}") for i, c in enumerate(columns)])
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"c{i}").alias("numeric"))
        for i, c in enumerate(columns)
    ]) if columns else F.array().cast("array<struct<position:int,column:string,numeric:bigint>>")
    share = F.try_divide(F.col("numeric").cast("double"), F.col("rows").cast("double"))
    return counts.select("rows", F.inline(cells)).select(
        "position", "column", "rows", "numeric", share.alias("ratio"),
        F.coalesce(share >= ratio, F.lit(False)).alias("promoted"))


def clean_frame(df: DataFrame, ratio: float = 0.80) -> DataFrame:
    """Trimmed names; text columns that are at least `ratio` numeric become double, the others are stripped.

    Deciding the types takes one pass over the table; only one short row per column reaches the driver.
    """
    df = trim_columns(df)
    promoted = {r["column"] for r in numeric_ratios(df, ratio).where("promoted").select("column").collect()}

    def cleaned(field: T.StructField) -> Column:
        column = quoted(field.name)
        if isinstance(field.dataType, T.StringType):
            column = to_number(column) if field.name in promoted else strip(column)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = nan_to_null(column)
        return column.alias(field.name)

    return df.select(*[cleaned(f) for f in df.schema.fields])


def typed_accounts(df: DataFrame) -> DataFrame:
    """The telecom table with numeric columns as numbers and `label` as 1 / 0 / NULL."""
    numbers = {}
    for name in ("tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen"):
        if name in df.columns:
            field = df.schema[name].dataType
            if isinstance(field, T.StringType):
                numbers[name] = to_number(name)
            elif isinstance(field, (T.DoubleType, T.FloatType)):
                numbers[name] = nan_to_null(name)
    if "Churn" in df.columns:
        numbers["label"] = parse_label("Churn")
    return df.withColumns(numbers)


def drop_unlabelled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.dropna(subset=[label])


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(columns) if columns else None)


def split_features(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The model input: the table without its key, its label and derived columns. Absent names are ignored."""
    return df.drop(*domain.DERIVED_COLUMNS, *extra)
