"""Sliced running totals, quantiles and ranks against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keepwell.operators import ordering


@pytest.fixture(scope="module")
def numbers():
    rng = random.Random(7)
    hot = [("a", 0.25)] * 400  # a third of all rows is one value
    spread = [(g, rng.choice([rng.random(), rng.gauss(0, 1e6), float(rng.randint(-5, 5)), 1e-9 * rng.random()]))
              for g in "aabc" for _ in range(200)]
    return hot + spread


def test_exact_quantiles_match_numpy(spark, numbers):
    points = [i * 0.1 for i in range(10)] + [1.0]
    df = spark.createDataFrame(numbers + [("a", None), ("c", float("nan")), (None, 1.0)], "g string, v double")
    whole = {r["g"]: r for r in ordering.exact_quantiles(df, "v", points, ["g"]).collect()}
    for g in "abc":
        mine = [v for k, v in numbers if k == g]
        assert whole[g]["n"] == len(mine)
        assert whole[g]["quantiles"] == [float(x) for x in np.quantile(mine, points)]
    assert (whole[None]["n"], whole[None]["quantiles"][0]) == (1, 1.0)


def test_quantiles_without_groups_match_pandas(spark, numbers):
    df = spark.createDataFrame(numbers, "g string, v double")
    row = ordering.exact_quantiles(df, "v", [0.25, 0.5, 0.75]).first()
    assert row["quantiles"] == pd.Series([v for _, v in numbers]).quantile([0.25, 0.5, 0.75]).tolist()


def test_approximate_quantiles_are_close_in_rank(spark, numbers):
    df = spark.createDataFrame(numbers, "g string, v double")
    median = ordering.quantiles(df, "v", [0.5], exact=False).first()["quantiles"][0]
    ordered = sorted(v for _, v in numbers)
    assert abs(np.searchsorted(ordered, median) - len(ordered) / 2) <= len(ordered) * 0.36  # the hot value fills ranks
    assert ordering.exact_quantiles(df, "v", [0.5]).first()["quantiles"][0] == pytest.approx(np.median(ordered))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, numbers, descending):
    table = {}
    for g, v in numbers:
        table[(g, v)] = table.get((g, v), 0) + 1
    df = spark.createDataFrame([(g, v, n) for (g, v), n in table.items()], "g string, v double, n long")
    for row in ordering.running_totals(df, "v", ["n"], ["g"], descending).collect():
        before = sum(n for (g, v), n in table.items()
                     if g == row["g"] and (v > row["v"] if descending else v < row["v"]))
        assert row["n_before"] == before


def test_slices_never_decrease(spark):
    values = sorted([0.0, -1e300, 1e300, 5e-324, -5e-324, 1.0, 1 + 1e-15, -3.5] + [i / 977 for i in range(-500, 500)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    slices = [r[0] for r in ordering.with_slices(df, "v").orderBy("i").select("_slice").collect()]
    assert slices == sorted(slices)


@pytest.mark.parametrize("low, step", [(1.7e12, 1.0), (0.0, 1e-9), (1e15, 4.0)])
def test_slices_are_even_wherever_the_values_lie(spark, low, step):
    df = spark.range(100_000).select((F.lit(low) + F.col("id") * step).alias("v"))
    sizes = [r["count"] for r in ordering.with_slices(df, "v").groupBy("_slice").count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) <= 4 * 100_000 / ordering.SLICES


def test_null_groups_and_keys_stay(spark):
    df = spark.createDataFrame([("a", 1.0, 1), (None, 2.0, 1), (None, 4.0, 1)], "g string, v double, n long")
    found = {r["g"]: (r["n"], r["quantiles"]) for r in ordering.exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert found == {"a": (1, [1.0]), None: (2, [3.0])}
    totals = ordering.running_totals(df, "v", ["n"], ["g"]).collect()
    assert sorted((r["v"], r["n_before"]) for r in totals) == [(1.0, 0), (2.0, 0), (4.0, 1)]
    keyed = spark.createDataFrame([("k", "x"), (None, "x"), (None, None), ("k", "x")], "key string, g string")
    ranks = ordering.hashed_rank(keyed, "key", ["g"]).collect()
    assert sorted((r["g"] or "", r["_rank"], r["_size"]) for r in ranks) == [("", 0, 1), ("x", 0, 3), ("x", 1, 3), ("x", 2, 3)]


def test_empty_column_has_no_quantiles(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert ordering.exact_quantiles(df, "v", [0.5], ["g"]).count() == 0


def test_hashed_rank_is_a_permutation_of_each_group(spark):
    df = spark.createDataFrame([(f"k{i}", i % 7 == 0) for i in range(700)], "key string, big boolean")
    rows = ordering.hashed_rank(df, "key", ["big"]).collect()
    for flag in (True, False):
        ranks = sorted(r["_rank"] for r in rows if r["big"] == flag)
        assert ranks == list(range(len(ranks)))
        assert {r["_size"] for r in rows if r["big"] == flag} == {len(ranks)}


@pytest.mark.parametrize("coarse", [ordering.SLICES, 4])
@pytest.mark.parametrize("slice_rows", [1, 7, 100_000])
def test_any_number_of_slices_gives_the_same(spark, numbers, monkeypatch, coarse, slice_rows):
    monkeypatch.setattr(ordering, "SLICES", coarse)
    monkeypatch.setattr(ordering, "SLICE_ROWS", slice_rows)
    df = spark.createDataFrame(numbers, "g string, v double")
    points = [0.0, 0.1, 0.5, 0.75, 1.0]
    for r in ordering.exact_quantiles(df, "v", points, ["g"]).collect():
        assert r["quantiles"] == [float(x) for x in np.quantile([v for g, v in numbers if g == r["g"]], points)]
    assert ordering.exact_quantiles(df, "v", [0.5]).first()["quantiles"] == [float(np.quantile([v for _, v in numbers], 0.5))]
    counts = df.groupBy("v").agg(F.count("*").alias("n"))
    for r in ordering.running_totals(counts, "v", ["n"], descending=True).collect():
        assert r["n_before"] == sum(v > r["v"] for _, v in numbers)


def test_slices_follow_the_rows():
    assert [ordering.slices_for(n, 100) for n in (0, 1, 100, 101, 200, 201, 100_000)] == [1, 1, 1, 2, 2, 4, 1024]


def test_fine_slices_have_a_size(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SLICES", 16)
    df = spark.range(20_000).select((F.col("id") * F.col("id")).cast("double").alias("v"))
    found = ordering.with_slices(df, "v", 256)
    sizes = [r["count"] for r in found.groupBy("_slice").count().collect()]
    assert len(sizes) > 200 and max(sizes) <= 4 * 20_000 / 256
    ordered = [r["_slice"] for r in found.orderBy("v").select("_slice").collect()]
    assert ordered == sorted(ordered)


@pytest.mark.parametrize("rows", [1, 100_000])
def test_running_totals_over_an_aggregate_of_a_scan(spark, sf, monkeypatch, rows):
    monkeypatch.setattr(ordering, "SLICE_ROWS", rows)
    prices = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_extendedprice").agg(F.count("*").alias("n"))
    found = ordering.running_totals(prices, "l_extendedprice", ["n"]).orderBy("l_extendedprice").collect()
    before = 0
    for r in found:
        assert r["n_before"] == before
        before += r["n"]


def test_quantiles_of_several_weights(spark, numbers):
    table = {}
    for place, (g, v) in enumerate(numbers):
        table.setdefault((g, v), [0, 0, 0])[place % 2] += 1
    counts = spark.createDataFrame([(g, v, *n) for (g, v), n in table.items()], "g string, v double, a long, b long, none long")
    for rows in (5, 100_000):
        for r in ordering.quantiles_of_counts(counts, "v", ["a", "b", "none"], [0.25, 0.5], ["g"], rows).collect():
            for place, w in enumerate("ab"):
                mine = [v for i, (g, v) in enumerate(numbers) if g == r["g"] and i % 2 == place]
                assert r[f"{w}_total"] == len(mine)
                assert r[f"{w}_quantiles"] == [float(x) for x in np.quantile(mine, [0.25, 0.5])]
            assert r["none_total"] == 0 and r["none_quantiles"] == [None, None]
