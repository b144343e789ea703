"""Column-wise preprocessing as a Spark ML pipeline: impute, scale and one-hot encode, numeric columns first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell import domain
from keepwell.functions.values import nan_to_null, quoted
from keepwell.operators.cleaning import long_form
from keepwell.operators.ordering import exact_quantiles, quantiles_of_counts
from keepwell.session import stored

FEATURES = "features"
FEW_CATEGORIES = 64  # up to so many are comparisons in SQL, more are indexed and encoded


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, median) of numeric columns, exact, without gathering a column anywhere."""
    cells = df.select(*[quoted(c).cast("double").alias(c) for c in columns]).unpivot(
        [], [quoted(c) for c in columns], "column", "value")
    return exact_quantiles(cells, "value", [0.5], ["column"]).select(
        "column", "n", F.get("quantiles", F.lit(0)).alias("median"))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mode, n) of text columns; the smallest value wins ties."""
    counted = long_form(df, columns).where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("order"), "value")).alias("best")
    return counted.groupBy("column").agg(best).select(
        "column", F.col("best.value").alias("mode"), (-F.col("best.order")).alias("n"))


@dataclass(frozen=True)
class Side:
    """What preprocessing learns from one training side."""

    rows: int
    labels: dict[str, int]  # rows per label, when one was counted
    medians: dict[str, float | None]
    means: dict[str, float]  # of the filled columns
    deviations: dict[str, float]
    modes: dict[str, str | None]
    categories: dict[str, list[str]]


def learn_sides(frame: DataFrame, numeric: Sequence[str], categorical: Sequence[str], sides: Sequence[Sequence[int]],
                part: Column | None = None, parts: int = 1, label: str | None = None) -> list[Side]:
    """Statistics of several overlapping sides of a table, each a set of parts, from one scan of it.

    `part` numbers the rows' parts from 0. Every column's values are counted once, with one count per part, and stored;
    a side's counts are sums of those. Medians of all sides come from one ordering of the counted values, means and
    deviations from sums of squares per part, modes and categories from the counts. What reaches the driver is a row per
    numeric column and one per category, as the fitted model holds them.
    """
    texts = [*categorical, *([label] if label else [])]
    cells = [F.struct(F.lit(i).alias("at"), nan_to_null(quoted(c).cast("double")).alias("number"),
                      F.lit(None).cast("string").alias("text")) for i, c in enumerate(numeric)]
    cells += [F.struct(F.lit(len(numeric) + i).alias("at"), F.lit(None).cast("double").alias("number"),
                       F.nullif(quoted(c).cast("string"), F.lit("")).alias("text")) for i, c in enumerate(texts)]
    cells.append(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("double").alias("number"),
                          F.lit(None).cast("string").alias("text")))  # counts the rows
    long = frame.select((F.lit(0) if part is None else part).alias("_part"), F.inline(F.array(*cells)))
    counted = stored(long.groupBy("at", "number", "text").agg(*[
        F.count_if(F.col("_part") == p).alias(f"n{p}") for p in range(parts)]), "column-counts")

    size = [0] * parts
    counts: dict[int, dict[str, list[int]]] = {i: {} for i in range(len(numeric), len(numeric) + len(texts))}
    for row in counted.where("at = -1 or text is not null").collect():
        if row["at"] < 0:
            size = [row[f"n{p}"] for p in range(parts)]
        else:
            counts[row["at"]][row["text"]] = [row[f"n{p}"] for p in range(parts)]
    numbers = counted.where("number is not null")
    middle = _side_medians(numbers, sides) if numeric else {}
    moments = _part_moments(numbers, numeric, parts) if numeric else {}

    learned = []
    for s, side in enumerate(sides):
        rows = sum(size[p] for p in side)
        medians_, means, deviations = {}, {}, {}
        for i, c in enumerate(numeric):
            medians_[c] = middle.get((i, s))
            known = _united([moments[i, p] for p in side if (i, p) in moments])
            filled = _united([known, (rows - known[0], medians_[c] or 0.0, 0.0)])
            means[c] = filled[1]
            deviations[c] = (filled[2] / (filled[0] - 1)) ** 0.5 if filled[0] > 1 else 0.0
        found = {c: {v: n for v, per in counts[len(numeric) + i].items() if (n := sum(per[p] for p in side))}
                 for i, c in enumerate(texts)}
        modes_ = {c: min(found[c], key=lambda v: (-found[c][v], v), default=None) for c in categorical}
        learned.append(Side(rows, found[label] if label else {}, medians_, means, deviations, modes_,
                            {c: sorted(found[c]) for c in categorical}))
    return learned


def _side_medians(numbers: DataFrame, sides: Sequence[Sequence[int]]) -> dict[tuple[int, int], float]:
    """The median of every (numeric column, side)."""
    sums = [reduce(add, [F.col(f"n{p}") for p in side], F.lit(0)).alias(f"w{s}") for s, side in enumerate(sides)]
    weights = [f"w{s}" for s in range(len(sides))]
    found = quantiles_of_counts(numbers.select("at", "number", *sums), "number", weights, [0.5], ["at"])
    return {(row["at"], s): row[f"w{s}_quantiles"][0] for row in found.collect() for s in range(len(sides))}


def _part_moments(numbers: DataFrame, numeric: Sequence[str], parts: int) -> dict[tuple[int, int], tuple]:
    """(rows, mean, sum of squared deviations) of every (numeric column, part).

    Values are shifted by the column's mean before they are squared, so that the sums don't cancel.
    """
    every = reduce(add, [F.col(f"n{p}") for p in range(parts)])
    centre = {r["at"]: r["mean"] for r in numbers.groupBy("at").agg(
        (F.sum(F.col("number") * every) / F.sum(every)).alias("mean")).collect()}
    if not centre:
        return {}
    shift = F.element_at(F.create_map(*[F.lit(x) for pair in centre.items() for x in pair]), F.col("at"))
    moved = F.col("number") - shift
    sums = numbers.withColumn("moved", moved).groupBy("at").agg(
        *[F.sum(f"n{p}").alias(f"n{p}") for p in range(parts)],
        *[F.sum(F.col("moved") * F.col(f"n{p}")).alias(f"s{p}") for p in range(parts)],
        *[F.sum(F.col("moved") * F.col("moved") * F.col(f"n{p}")).alias(f"q{p}") for p in range(parts)])
    out = {}
    for r in sums.collect():
        for p in range(parts):
            if n := r[f"n{p}"]:
                mean = r[f"s{p}"] / n
                out[r["at"], p] = (n, centre[r["at"]] + mean, max(r[f"q{p}"] - n * mean * mean, 0.0))
    return out


def _united(parts: Sequence[tuple]) -> tuple:
    """(rows, mean, sum of squared deviations) of several sets of rows together."""
    n, mean, square = 0, 0.0, 0.0
    for more, other, its in parts:
        if more:
            gap = other - mean
            square += its + gap * gap * n * more / (n + more)
            mean += gap * more / (n + more)
            n += more
    return n, mean, square


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fitted(spark: SparkSession, side: Side) -> PipelineModel:
    """Preprocessing with a side's statistics, without another look at the data.

    Missing numbers get the median and missing texts the mode; numbers are standardised, a constant one is 0; each seen
    category has a slot, and an unseen one gives all zeros. All stages are Spark's own, so the model saves and loads
    natively. An empty text is missing. A numeric column without any value is 0, a text column without any has no slot.
    """
    numbers = []
    for c in side.medians:
        value = f"coalesce(cast(`{c}` as double), {float(side.medians[c] or 0.0)!r}D)"
        spread = side.deviations[c]
        scaled = f"({value} - {side.means[c]!r}D) / {spread!r}D" if spread > 0 else "0D"
        numbers.append(f"{scaled} as `n_{c}`")
    known = {c: m for c, m in side.modes.items() if m is not None}
    filled = {c: f"coalesce(nullif(cast(`{c}` as string), ''), {_sql_text(m)})" for c, m in known.items()}
    few = [c for c in known if len(side.categories[c]) <= FEW_CATEGORIES]
    many = [c for c in known if c not in few]
    slots = {_slot(c, v): f"cast({filled[c]} = {_sql_text(v)} as double)" for c in few for v in side.categories[c]}
    texts = [f"{text} as `{name}`" for name, text in slots.items()] + [f"{filled[c]} as `c_{c}`" for c in many]
    stages = [SQLTransformer(statement=f"select *, {', '.join([*numbers, *texts])} from __THIS__")]
    if many:
        indexers = [StringIndexerModel.from_labels(side.categories[c], f"c_{c}", f"i_{c}", "keep") for c in many]
        encoder = OneHotEncoder(inputCols=[f"i_{c}" for c in many], outputCols=[f"v_{c}" for c in many], dropLast=True)
        # the number of categories is in the columns' metadata, so an empty table is enough to fit it
        nothing = spark.createDataFrame([], ", ".join(f"`c_{c}` string" for c in many))
        stages += [*indexers, encoder.fit(PipelineModel(stages=indexers).transform(nothing))]
    parts = [f"n_{c}" for c in side.medians]
    for c in known:
        parts += [_slot(c, v) for v in side.categories[c]] if c in few else [f"v_{c}"]
    return PipelineModel(stages=[*stages, VectorAssembler(inputCols=parts, outputCol=FEATURES)])


def _slot(column: str, category: str) -> str:
    """A column's name for one category; the category is spelled in hexadecimal, as names don't take every character."""
    return f"s_{column}_{category.encode().hex()}"


class Preprocessor:
    """Median / mode imputation, standardised numbers, then one slot per seen category, learned from one scan."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str]):
        self.numeric, self.categorical = list(numeric), list(categorical)

    def fit(self, df: DataFrame) -> PipelineModel:
        return fitted(df.sparkSession, learn_sides(df, self.numeric, self.categorical, [[0]])[0])


def preprocessor(numeric: Sequence[str] = tuple(domain.NUMERIC_FEATURES),
                 categorical: Sequence[str] = tuple(domain.CATEGORICAL_FEATURES)) -> Preprocessor:
    return Preprocessor(numeric, categorical)


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the feature slots: bare numeric columns, then `column_category`."""
    stages = flat_stages(model)
    indexed = {s.getInputCol().removeprefix("c_"): s.labels for s in stages if isinstance(s, StringIndexerModel)}
    names: list[str] = []
    for part in next(s for s in stages if isinstance(s, VectorAssembler)).getInputCols():
        kind, column = part[:2], part[2:]
        if kind == "n_":
            names.append(column)
        elif kind == "v_":
            names += [f"{column}_{label}" for label in indexed[column]]
        else:
            column, category = column.rsplit("_", 1)
            names.append(f"{column}_{bytes.fromhex(category).decode()}")
    return names


def flat_stages(model: PipelineModel) -> list:
    stages = []
    for stage in model.stages:
        stages += flat_stages(stage) if isinstance(stage, PipelineModel) else [stage]
    return stages
