"""Pearson correlations of every pair of columns, over the rows that have both values.

Each task turns its Arrow batches into one matrix product per batch and keeps, for every pair, the number of complete
rows, the two means, the two sums of squared deviations and the sum of products of deviations. Such moments merge without
cancellation (Chan, Golub and LeVeque, 1983). They travel as square blocks of columns, so that no task merges the whole
matrix. A wide table costs one scan, and no plan grows with the number of pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.functions.values import quoted

BLOCK = 32  # columns of a block
SPREAD = 64  # tasks that first merge the parts of one block
ROWS = 20_000  # rows of one product
CONSTANT = 1e-12  # a sum of squares this small, of the raw one, is rounding

# tasks get this module's functions with the job, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAMES = ["n", "shift_x", "shift_y", "mean_x", "mean_y", "square_x", "square_y", "product"]
Moments = dict[str, np.ndarray]


def moments(x: np.ndarray) -> Moments:
    """Moments of all pairs of columns of x; NaN is missing. `mean_x[i, j]` is of column i where j is present, too.

    Values are shifted by each column's median first, which keeps products small and constants exactly zero. Means stay
    relative to that shift, so that columns far from zero lose no digits.
    """
    known = ~np.isnan(x)
    every = bool(known.all())
    ordered = np.sort(x, axis=0)
    middle = np.maximum(known.sum(axis=0) - 1, 0) // 2
    shift = np.nan_to_num(ordered[middle, np.arange(x.shape[1])], nan=0.0, posinf=0.0, neginf=0.0)
    moved = np.where(known, x - shift, 0.0)
    product = moved.T @ moved
    if every:
        n = np.full(product.shape, float(len(x)))
        total = np.repeat(moved.sum(axis=0)[:, None], x.shape[1], axis=1)
        raw = np.repeat(np.diagonal(product)[:, None], x.shape[1], axis=1)
    else:
        here = known.astype(float)
        n, total, raw = here.T @ here, moved.T @ here, (moved * moved).T @ here
    mean = total / np.maximum(n, 1.0)
    square = raw - n * mean * mean
    square[square <= CONSTANT * raw] = 0.0
    shifts = np.repeat(shift[:, None], len(shift), axis=1)
    return {"n": n, "shift_x": shifts, "shift_y": shifts.T, "mean_x": mean, "mean_y": mean.T, "square_x": square,
            "square_y": square.T, "product": product - n * mean * mean.T}


def merged(a: Moments, b: Moments) -> Moments:
    """Moments of two sets of rows together."""
    n = a["n"] + b["n"]
    share = b["n"] / np.maximum(n, 1.0)
    weight = a["n"] * share
    first = a["n"] > 0
    gap = {axis: (b[f"shift_{axis}"] - a[f"shift_{axis}"]) + (b[f"mean_{axis}"] - a[f"mean_{axis}"]) for axis in "xy"}
    # where one side has no rows its mean says nothing
    x, y = (np.where(weight > 0, gap[axis], 0.0) for axis in "xy")
    return {
        "n": n,
        "shift_x": np.where(first, a["shift_x"], b["shift_x"]), "shift_y": np.where(first, a["shift_y"], b["shift_y"]),
        "mean_x": np.where(first, a["mean_x"] + x * share, b["mean_x"]),
        "mean_y": np.where(first, a["mean_y"] + y * share, b["mean_y"]),
        "square_x": a["square_x"] + b["square_x"] + x * x * weight,
        "square_y": a["square_y"] + b["square_y"] + y * y * weight,
        "product": a["product"] + b["product"] + x * y * weight,
    }


def _all_merged(parts: pd.DataFrame) -> Moments:
    total = None
    for row in parts.sort_values("task").itertuples():
        one = {name: np.frombuffer(getattr(row, name)) for name in NAMES}
        total = one if total is None else merged(total, one)
    return total


def correlation_table(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(i, j, correlation) for every pair i < j of numeric columns.

    NULL and NaN are missing. The correlation is NULL where fewer than two rows are complete, where a side is constant in
    them, and where an infinity is among them. A task holds some square matrices of the number of columns.
    """
    width = len(columns)
    edges = list(range(0, width, block))
    values = df.select(*[F.coalesce(quoted(c).cast("double"), F.lit(float("nan"))).alias(f"c{k}")
                         for k, c in enumerate(columns)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, rows = None, [], 0

        def add() -> None:
            nonlocal total
            found = moments(np.concatenate(waiting))
            total = found if total is None else merged(total, found)

        with np.errstate(all="ignore"):
            for batch in batches:
                waiting.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
                rows += len(batch)
                if rows >= ROWS:
                    add()
                    waiting, rows = [], 0
            if rows:
                add()
        if total is not None:
            task = TaskContext.get().partitionId()
            for a in edges:
                for b in edges[edges.index(a):]:
                    cells = {name: [np.ascontiguousarray(total[name][a:a + block, b:b + block]).tobytes()] for name in NAMES}
                    yield pa.RecordBatch.from_pydict({"a": [a], "b": [b], "task": [task], **cells}, schema=arrow)

    schema = "a int, b int, task int, " + ", ".join(f"{name} binary" for name in NAMES)
    arrow = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("task", pa.int32()), *[(name, pa.binary()) for name in NAMES]])

    def combine(parts: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            total = _all_merged(parts)
        return pd.DataFrame({"a": parts["a"].iloc[:1], "b": parts["b"].iloc[:1], "task": parts["task"].min(),
                             **{name: [total[name].tobytes()] for name in NAMES}})

    def finish(parts: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            total = _all_merged(parts)
            r = total["product"] / (np.sqrt(total["square_x"]) * np.sqrt(total["square_y"]))
        a, b = int(parts["a"].iloc[0]), int(parts["b"].iloc[0])
        high, wide = min(block, width - a), min(block, width - b)
        i, j = np.repeat(np.arange(a, a + high), wide), np.tile(np.arange(b, b + wide), high)
        # one row alone has no spread, so it gives 0 / 0
        return pd.DataFrame({"i": i, "j": j, "correlation": np.where(np.isfinite(r), np.clip(r, -1, 1), np.nan)})[i < j]

    parts = values.mapInArrow(measure, schema).groupBy("a", "b", F.expr(f"task % {SPREAD}").alias("salt")).applyInPandas(
        combine, schema)
    found = parts.groupBy("a", "b").applyInPandas(finish, "i int, j int, correlation double")
    pairs = df.sparkSession.range(width * width).select(
        F.floor(F.col("id") / width).cast("int").alias("i"), (F.col("id") % width).cast("int").alias("j")).where("i < j")
    return pairs.join(found, ["i", "j"], "left").withColumn("correlation", F.nanvl("correlation", F.lit(None).cast("double")))
