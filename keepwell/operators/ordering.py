"""Ordered computations that never put a whole column into one task.

A total order over a big column is cut into slices at approximate quantiles of its values. Slice totals are few, so a
window over them is small; the work inside a slice is spread over the cluster by the slice number. The rows to order are
written once, so that the sketch that places the edges and the ordering read the same stored rows, and their number says
how many slices it takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.functions.values import as_column, hash_bucket, quoted
from keepwell.session import stored

SLICES = 4096  # a power of two: slices of one sketch
SLICE_ROWS = 100_000  # rows that one task may order
RANK_SLICES = 1 << 16


def slices_for(rows: int, slice_rows: int | None = None) -> int:
    """The power of two that keeps slices of `rows` rows at or under `slice_rows` on average."""
    return 1 << max(0, -(-rows // (slice_rows or SLICE_ROWS)) - 1).bit_length()


def _points(slices: int) -> Column:
    # one literal, as thousands of them are slow to build
    return F.split(F.lit(",".join(str(i / slices) for i in range(1, slices))), ",").cast("array<double>")


def _place(edges: Column, slices: int) -> Column:
    """How many of the edges are at or below `_sliced`, by binary search; none, if there are no edges."""
    steps = F.array(*[F.lit(slices >> i) for i in range(1, slices.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        F.get(edges, low + step - 1) <= F.col("_sliced"), low + step).otherwise(low))


def with_slices(df: DataFrame, value: Column | str, slices: int = SLICES) -> DataFrame:
    """Adds `_slice`, which never decreases as the value grows and holds about 1/slices of the rows, wherever these lie.

    `df` holds one row per value (and group), so no value fills a slice. The edges come from one sketch of the rows, whose
    error moves an edge but changes no order; NULL lies in the lowest slice and NaN in the highest. More than 4,096
    slices are cut in two steps: every slice of the first is cut again at edges of its own.
    """
    if slices == 1:
        return df.withColumn("_slice", F.lit(0))
    coarse, fine = min(slices, SLICES), max(1, slices // SLICES)
    table = df.withColumn("_sliced", as_column(value).cast("double"))
    edges = table.agg(F.percentile_approx("_sliced", _points(coarse), 10 * coarse)).first()[0]  # at most 4,095 numbers
    text = ",".join(map(repr, edges or []))
    at = F.split(F.lit(text), ",").cast("array<double>") if edges else F.array().cast("array<double>")
    table = table.withColumn("_edges", at).withColumn("_slice", _place(F.col("_edges"), coarse)).drop("_edges")
    if fine > 1:
        inner = table.groupBy("_slice").agg(F.percentile_approx("_sliced", _points(fine), 10 * fine).alias("_edges"))
        # 4,096 rows of `fine` numbers
        table = table.join(F.broadcast(inner), "_slice").withColumn(
            "_slice", F.col("_slice") * fine + _place(F.col("_edges"), fine)).drop("_edges")
    return table.select(*[quoted(c) for c in df.columns], "_slice")


def _grouped(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the group as one struct: structs of NULLs are equal, so a NULL group stays in a join."""
    return df.withColumn("_group", F.struct(F.lit(0).alias("_all"), *[quoted(c) for c in by]))


def running_totals(df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (),
                   descending: bool = False, slice_rows: int | None = None) -> DataFrame:
    """Adds `<name>_before`: the total of `name` over the rows ordered before this one.

    `df` holds one row per (`by`, `value`), so equal values are already one row; NULL is a group like others. The rows are
    stored first.
    """
    by, columns = list(by), df.columns
    df = stored(df, "ordered")
    slices = slices_for(df.count(), slice_rows)
    sliced = with_slices(_grouped(df, by), value, slices)
    if descending:
        sliced = sliced.withColumn("_slice", -F.col("_slice"))
    keys = ["_group", "_slice"]
    order = F.desc(value) if descending else F.asc(value)
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = {s: F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}
    if slices == 1:
        return sliced.select(*columns, *[before[s].alias(f"{s}_before") for s in sums])
    across = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
    starts = totals.select(*keys, *[F.coalesce(F.sum(s).over(across), F.lit(0)).alias(f"_{s}_start") for s in sums])
    return sliced.join(starts, keys).select(
        *columns, *[(F.col(f"_{s}_start") + before[s]).alias(f"{s}_before") for s in sums])


def _interpolate(low: Column, high: Column, share: Column) -> Column:
    """Linear interpolation, from the nearer end, as numpy does it."""
    span = high - low
    return F.when(share >= 0.5, high - span * (1 - share)).otherwise(low + span * share)


def exact_quantiles(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles per group: (`by`..., n, quantiles array<double>). NULL is a group like others.

    Distinct values are counted first (map-side combined, so a hot value is one row), and the counts are stored.
    """
    counts = (
        df.select(*by, as_column(value).cast("double").alias("_value"))
        .where(F.col("_value").isNotNull() & ~F.isnan("_value"))
        .groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_n"))
    )
    found = quantiles_of_counts(stored(counts, "counts"), "_value", ["_n"], points, by)
    return found.select(*by, F.col("_n_total").alias("n"), F.col("_n_quantiles").alias("quantiles"))


def quantiles_of_counts(counts: DataFrame, value: str, weights: Sequence[str], points: Sequence[float],
                        by: Sequence[str] = (), slice_rows: int | None = None) -> DataFrame:
    """(`by`..., <w>_total, <w>_quantiles for each weight): quantiles of values that occur <w> times each.

    `counts` is a stored table of one row per (`by`, `value`). Totals per slice locate the slices holding a wanted rank
    of any weight, and only those slices are ordered value by value. A group whose weight is 0 has NULL quantiles.
    """
    by, k = list(by), len(weights)
    keys = ["_group", "_slice"]
    slices = slices_for(counts.count(), slice_rows)
    sliced = with_slices(_grouped(counts, by), value, slices)
    group = Window.partitionBy("_group")
    upto = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    wanted_points = F.array(*[F.lit(float(p)) for p in points])

    def place(w: str, point: Column) -> Column:
        return (F.col(f"{w}_total") - 1) * point

    def ranks(w: str, first: Column, size: Column) -> Column:
        """The wanted ranks among `size` values from `first` on."""
        ends = F.concat(F.transform(wanted_points, lambda p: F.floor(place(w, p))),
                        F.transform(wanted_points, lambda p: F.ceil(place(w, p))))
        return F.filter(F.array_distinct(ends), lambda r: (r >= first) & (r < first + size))

    if slices == 1:
        placed = sliced.withColumns({f"{w}_total": F.sum(w).over(group) for w in weights}).withColumns(
            {f"{w}_start": F.lit(0) for w in weights})
    else:
        totals = sliced.groupBy(*keys).agg(*[F.sum(w).alias(w) for w in weights]).select(
            *keys, *weights, *[F.coalesce(F.sum(w).over(upto), F.lit(0)).alias(f"{w}_start") for w in weights],
            *[F.sum(w).over(group).alias(f"{w}_total") for w in weights])
        held = F.lit(False)
        for w in weights:
            held = held | (F.size(ranks(w, F.col(f"{w}_start"), F.col(w))) > 0)
        hot = totals.where(held).drop(*weights)
        if not by:
            hot = F.broadcast(hot)  # at most two slices per point and weight
        placed = sliced.join(hot, keys)
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({
        f"{w}_first": F.col(f"{w}_start") + F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})

    def entry(i: int):
        return lambda r: F.struct((r * k + i).alias("rank"), quoted(value).alias("value"))

    entries = F.concat(*[
        F.transform(ranks(w, F.col(f"{w}_first"), F.col(w)), entry(i)) for i, w in enumerate(weights)])
    totals = [f"{w}_total" for w in weights]
    held = placed.select(*by, *totals, F.explode(entries).alias("_entry"))
    # at most two ranks per point, weight and group
    found = held.groupBy(*by, *totals).agg(F.map_from_entries(F.collect_list("_entry")).alias("_at"))

    def quantile(w: str, i: int):
        def of(point: Column) -> Column:
            low, high = (F.col("_at")[end(place(w, point)) * k + i] for end in (F.floor, F.ceil))
            return _interpolate(low, high, place(w, point) - F.floor(place(w, point)))

        return of

    return found.select(*by, *totals, *[
        F.transform(wanted_points, quantile(w, i)).alias(f"{w}_quantiles") for i, w in enumerate(weights)])


def approximate_quantiles(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = (),
                          accuracy: int = 10000) -> DataFrame:
    """The same table from one sketch per group: a single pass, rank error up to 1/accuracy."""
    value = as_column(value).cast("double")
    return df.where(value.isNotNull() & ~F.isnan(value)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(value, [float(p) for p in points], accuracy).alias("quantiles"))


def quantiles(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = (),
              exact: bool = True) -> DataFrame:
    return (exact_quantiles if exact else approximate_quantiles)(df, value, points, by)


def hashed_rank(df: DataFrame, key: str, by: Sequence[str], seed: int = 42) -> DataFrame:
    """Adds `_rank` (from 0) and `_size` within each `by` group, in the order of the key's hash.

    Groups may be as few as two labels, so each is cut into hash slices: a slice's start comes from the slice counts
    and only a slice is sorted in one task. NULL is a key and a group like others; NULL keys are in the first slice.
    """
    sliced = _grouped(df, by).withColumn("_slice", F.coalesce(hash_bucket(key, RANK_SLICES, seed), F.lit(0)))
    keys = ["_group", "_slice"]
    group = Window.partitionBy("_group")
    upto = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"), F.sum("_n").over(group).alias("_size"))
    inside = Window.partitionBy(*keys).orderBy(F.md5(quoted(key).cast("string").cast("binary")), quoted(key))
    return sliced.join(starts, keys).select(
        *df.columns, "_size", (F.col("_start") + F.row_number().over(inside) - 1).alias("_rank"))
