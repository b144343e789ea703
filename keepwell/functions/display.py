"""Display texts. Digits are rounded on the exact binary value, half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepwell.functions.values import as_column


def fixed(column: Column | str, digits: int) -> Column:
    """`1234.5` as `1234.50`."""
    return F.replace(fmt_int(column, digits), F.lit(","))


def fmt_int(column: Column | str, digits: int = 0) -> Column:
    """`1234` as `1,234`."""
    return F.format_number(as_column(column).cast("double"), digits)


def fmt_money(column: Column | str) -> Column:
    return F.concat(F.lit("$"), fmt_int(column, 2))


def fmt_pct(column: Column | str, digits: int = 1) -> Column:
    """A number already in percent, e.g. `12.3%`."""
    return F.concat(fixed(column, digits), F.lit("%"))


def fmt_months(column: Column | str, digits: int = 0) -> Column:
    return F.concat(fixed(column, digits), F.lit(" months"))


def rounded(column: Column | str, digits: int) -> Column:
    return fixed(column, digits).cast("double")


def feature_text(column: Column | str) -> Column:
    """A model feature name for people: underscores become spaces."""
    return F.replace(as_column(column), F.lit("_"), F.lit(" "))


def title_text(column: Column | str) -> Column:
    return F.initcap(feature_text(column))


def bare_feature(column: Column | str) -> Column:
    """A feature name without the preprocessing branch it came from."""
    column = F.replace(as_column(column), F.lit("numeric__"), F.lit(""))
    return F.replace(column, F.lit("categorical__"), F.lit(""))


def driver_text(feature: Column | str, shap: Column | str) -> Column:
    """What a driver does to the predicted risk; a zero contribution counts as lower."""
    direction = F.when(as_column(shap) > 0, F.lit("higher")).otherwise(F.lit("lower"))
    return F.concat(feature_text(feature), F.lit(" — contributes to "), direction, F.lit(" predicted churn risk."))
