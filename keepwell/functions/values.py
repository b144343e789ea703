"""Text, number and bucket expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = " \t\n\r\f\x0b"
NUMBER_PATTERN = r"(?i)^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$"


def quoted(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(column: Column | str) -> Column:
    return quoted(column) if isinstance(column, str) else column


def strip(column: Column | str) -> Column:
    return F.btrim(as_column(column).cast("string"), F.lit(WHITESPACE))


def to_number(column: Column | str) -> Column:
    """The number a text spells, else NULL. `1d`, `nan`, blanks and infinities are not numbers."""
    text = strip(column)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def is_number(column: Column | str) -> Column:
    return to_number(column).isNotNull()


def nan_to_null(column: Column | str) -> Column:
    column = as_column(column)
    return F.when(~F.isnan(column), column)


def normalize_name(column: Column | str, style: str = "fuzzy") -> Column:
    """Column name for comparison: `fuzzy` keeps [a-z0-9]; `strict` only drops spaces, `-` and `_`."""
    if style == "fuzzy":
        return F.regexp_replace(F.lower(as_column(column)), "[^a-z0-9]", "")
    return F.translate(F.lower(strip(column)), " -_", "")


def or_missing(column: Column | str, text: str = "Not available") -> Column:
    return F.coalesce(as_column(column).cast("string"), F.lit(text))


def clamp(column: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(as_column(column), F.lit(low)), F.lit(high))


def hash_bucket(column: Column | str, buckets: int, seed: int = 42) -> Column:
    """A bucket in [0, buckets) from the md5 of the value; any engine can recompute it."""
    digest = F.md5(F.concat(as_column(column).cast("string"), F.lit(f"#{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(buckets)


def count_passed(column: Column | str, edges: Sequence[float]) -> Column:
    """How many of the ascending `edges` are <= the value, as a binary search of nested CASEs."""
    column = as_column(column)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column < F.lit(edges[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(edges))


EXACT_LIMIT = 1e12


def exact_sum(column: Column | str) -> Column:
    """The sum of a number column in its own decimal digits, so that neither partitioning nor order changes the result.

    A double stands for its shortest decimal text (29.85 is 29.85) to 16 places after the point; such decimals add without
    rounding, and the total is rounded once. Values of 1e12 and more, NaN and infinities are added as doubles. NULL if
    there is no value, as with any sum.
    """
    value = as_column(column).cast("double")
    small = F.abs(value) < EXACT_LIMIT
    exact = F.try_sum(F.when(small, value).cast("decimal(38,16)")).cast("double")
    large = F.sum(F.when(~small, value))
    # beyond 22 digits before the point there is no exact total
    plain = F.sum(F.when(small, value))
    total = F.when(F.count_if(small) == 0, F.lit(0.0)).otherwise(F.coalesce(exact, plain))
    return F.when(F.count(value) > 0, total + F.coalesce(large, F.lit(0.0)))


def exact_mean(column: Column | str) -> Column:
    """The mean of a number column from its exact sum; NULL if there is no value."""
    return F.try_divide(exact_sum(column), F.count(as_column(column).cast("double")))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 over all cells of a row. Each cell carries its length, so different rows spell different texts."""
    cells = []
    for field in df.schema.fields:
        cell = quoted(field.name)
        if isinstance(field.dataType, T.BinaryType):
            cell = F.hex(cell)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cell = F.to_json(F.struct(cell))
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            cell = cell + F.lit(0.0)  # -0.0 equals 0.0
        text = cell.cast("string")
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*cells).cast("binary"), 256))
