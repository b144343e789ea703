"""Splits, training, scoring and explanations."""

import pickle
from itertools import combinations
from math import factorial, prod
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from catalog import learn
from keepwell.domain import BOOSTING, BOOSTING_SPACE, FOREST, LOGISTIC, LOGISTIC_SPACE, TIER_ORDER
from keepwell.operators.cleaning import typed_accounts
from keepwell.operators.evaluation import roc_auc
from keepwell.plans import boosted, explaining, forests, preprocessing, scoring, training, views
from keepwell.session import new_path
from keepwell.sources.champion import load_champion
from keepwell.streaming.ingest import stream_scores
from tests.conftest import SF

SETTINGS = training.quick_settings(folds=2, draws={LOGISTIC: 1, FOREST: 1, BOOSTING: 1})
SPACE = {"n_estimators": [8], "learning_rate": [0.1], "max_depth": [3], "min_samples_leaf": [1], "subsample": [1.0]}


@pytest.fixture(scope="module")
def accounts(spark):
    return views.stored_accounts(spark, SF).drop("k", "pts")


@pytest.fixture(scope="module")
def trained(spark, accounts):
    path = new_path(spark, "champion")
    champion, oof, tested = training.train_champion(accounts, SETTINGS, path, [LOGISTIC, BOOSTING],
                                                    {BOOSTING: SPACE}, choose=BOOSTING)
    return champion, oof, tested, path


def test_draws_are_seeded_and_distinct():
    assert len(training.draw(LOGISTIC_SPACE, 8)) == 8
    drawn = training.draw(BOOSTING_SPACE, 25)
    assert drawn == training.draw(BOOSTING_SPACE, 25)
    assert len({str(d) for d in drawn}) == 25


@pytest.mark.parametrize("exact", [False, True])
def test_splits_and_folds_keep_class_shares(accounts, exact):
    df = typed_accounts(accounts).dropna(subset=["label"])
    split = training.assign_folds(training.assign_split(df, exact=exact), 5, exact=exact)
    whole = df.agg(F.avg("label")).first()[0]
    near = 0.005 if exact else 0.08
    for column, sizes in (("split", [0.2, 0.8]), ("fold", [0.2])):
        for r in split.groupBy(column).agg(F.count("*").alias("n"), F.avg("label").alias("rate")).collect():
            assert abs(r["rate"] - whole) < near
            assert min(abs(r["n"] / df.count() - s) for s in sizes) < (0.002 if exact else 0.04)


def test_sides_equal_fits_of_their_own(spark):
    """Medians, modes, means and deviations of overlapping sides, against each side taken alone."""
    rng = np.random.default_rng(2)
    n = 500
    frame = pd.DataFrame({"part": rng.integers(0, 3, n), "x": rng.normal(1e6, 1, n).round(3), "y": rng.integers(0, 4, n).astype(float),
                          "t": rng.choice(["a", "b", "c'\\", ""], n), "label": rng.integers(0, 2, n)}).astype({"t": object})
    frame.loc[rng.random(n) < 0.2, "x"] = np.nan
    frame.loc[rng.random(n) < 0.2, "t"] = None
    frame.loc[frame["part"] == 2, "y"] = np.nan
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "part int, x double, y double, t string, label int")
    sides = [[1, 2], [0, 2], [0, 1], [2], [0, 1, 2]]
    learned = preprocessing.learn_sides(df, ["x", "y"], ["t"], sides, F.col("part"), 3, "label")
    for parts, side in zip(sides, learned):
        own = frame[frame["part"].isin(parts)]
        assert side.rows == len(own) and side.labels == {str(k): v for k, v in own["label"].value_counts().items()}
        for c in ("x", "y"):
            median = own[c].median() if own[c].notna().any() else None
            filled = own[c].fillna(median or 0.0)
            assert side.medians[c] == median
            assert side.means[c] == pytest.approx(filled.mean(), rel=1e-12)
            assert side.deviations[c] == pytest.approx(filled.std(), rel=1e-9)
        counts = own["t"].replace("", None).value_counts()  # an empty text is missing
        assert side.modes["t"] == min(counts[counts == counts.max()].index)
        assert side.categories["t"] == sorted(counts.index)
        alone = preprocessing.preprocessor(["x", "y"], ["t"]).fit(df.where(F.col("part").isin(parts))).transform(df)
        shared = preprocessing.fitted(spark, side).transform(df)
        columns = [vector_to_array("features").alias("f")]
        for mine, theirs in zip(shared.select(columns).collect(), alone.select(columns).collect()):
            assert np.allclose(mine["f"], theirs["f"], rtol=1e-9, atol=1e-9)


def test_many_categories_are_encoded_alike(spark, monkeypatch):
    rows = [(k * 1.5, f"v{k % 7}'`. {k % 3}" if k % 5 else None, "x" if k % 2 else "y") for k in range(40)]
    df = spark.createDataFrame(rows, "a double, t string, u string")
    whole = preprocessing.preprocessor(["a"], ["t", "u"]).fit(df)
    monkeypatch.setattr(preprocessing, "FEW_CATEGORIES", 2)
    mixed = preprocessing.preprocessor(["a"], ["t", "u"]).fit(df)
    assert preprocessing.feature_names(whole) == preprocessing.feature_names(mixed)
    path = new_path(spark, "mixed")
    mixed.write().save(path)
    odd = df.unionByName(spark.createDataFrame([(None, "new", "")], df.schema))
    vectors = [[r["f"] for r in m.transform(odd).select(vector_to_array("features").alias("f")).collect()]
               for m in (whole, mixed, PipelineModel.load(path))]
    assert vectors[0] == vectors[1] == vectors[2] and sum(vectors[0][-1][1:]) == 1.0


def test_columns_without_any_value(spark):
    df = spark.createDataFrame([(None, 1.0, None, "a"), (None, 2.0, "", "b")], "x double, y double, t string, u string")
    model = preprocessing.preprocessor(["x", "y"], ["t", "u"]).fit(df)
    assert preprocessing.feature_names(model) == ["x", "y", "u_a", "u_b"]
    rows = [r["f"] for r in model.transform(df).select(vector_to_array("features").alias("f")).collect()]
    assert [r[0] for r in rows] == [0.0, 0.0] and [r[2:] for r in rows] == [[1.0, 0.0], [0.0, 1.0]]


def test_search_goes_on_where_it_was_lost(spark, accounts, monkeypatch):
    settings = training.quick_settings(folds=2, fold_parallelism=1, parallelism=1, draws={LOGISTIC: 2, FOREST: 1, BOOSTING: 1})
    spaces = {BOOSTING: SPACE, FOREST: {"n_estimators": [3], "max_depth": [4], "min_samples_leaf": [1], "max_features": ["sqrt"]}}
    frame, ledger = training.prepare(accounts, settings), new_path(spark, "ledger")
    real, fits = training.tuned, []

    def counted(kind, drawn, *rest):
        if len(fits) == 5 and not resumed:
            raise RuntimeError("the driver is lost")
        fits.append(kind)
        return real(kind, drawn, *rest)

    monkeypatch.setattr(training, "tuned", counted)
    resumed = False
    with pytest.raises(RuntimeError):
        training.random_search(frame, settings, spaces=spaces, ledger=ledger)
    assert len(training.read_trials(spark, ledger)) == 5
    resumed = True
    results = training.random_search(frame, settings, spaces=spaces, ledger=ledger)
    assert len(fits) == 8 and {r.kind for r in results} == {LOGISTIC, FOREST, BOOSTING}
    assert training.random_search(frame, settings, spaces=spaces, ledger=ledger) == results and len(fits) == 8
    # other settings are other trials
    training.random_search(frame, training.replace(settings, seed=7), [BOOSTING], spaces, ledger)
    assert len(fits) == 10
    best = training.tuning_summary(spark, results).collect()
    assert [r["roc_auc"] for r in best] == sorted((r["roc_auc"] for r in best), reverse=True)


def test_every_training_row_is_predicted_once(trained, accounts):
    _, oof, tested, _ = trained
    frame = training.prepare(accounts, SETTINGS)
    assert oof.count() == oof.select("customerID").distinct().count() == training.training_rows(frame).count()
    assert tested.count() == frame.where("split = 'test'").count()
    moved = oof.join(frame.select("customerID", F.col("fold").alias("home")), "customerID").where("fold <> home")
    assert moved.count() == 0


def test_model_beats_chance_on_unseen_rows(trained):
    assert roc_auc(trained[2]).first()["roc_auc"] > 0.7


def test_threshold_comes_from_the_grid(trained):
    assert round(trained[0].threshold * 100) in range(10, 71)


def test_scores_survive_saving(spark, trained, accounts):
    before = scoring.with_probability(accounts, trained[0]).select("customerID", "probability")
    after = scoring.with_probability(accounts, load_champion(spark, trained[3])).select("customerID", "probability")
    assert before.exceptAll(after).count() == 0


def test_score_fills_every_row_even_with_unseen_and_missing_values(trained, accounts):
    odd = accounts.withColumn("PaymentMethod", F.lit("Barter")).withColumn("TotalCharges", F.lit(" ")).withColumn(
        "Contract", F.lit(None).cast("string"))
    scored = scoring.score(odd, trained[0])
    assert scored.where("probability is null or risk_tier is null").count() == 0
    assert scored.where("size(actions) not between 1 and 5").count() == 0
    assert {r[0] for r in scored.select("risk_tier").distinct().collect()} <= set(TIER_ORDER)


def test_scores_are_laid_out_by_tier(spark, trained, accounts):
    path = new_path(spark, "scores")
    scored = scoring.score(accounts, trained[0])
    scoring.write_scores(scored, path)
    stored = spark.read.parquet(path)
    assert stored.count() == scored.count()
    critical = stored.where("risk_tier = 'CRITICAL'")
    assert critical.count() == scored.where("risk_tier = 'CRITICAL'").count()
    read = [r[0] for r in critical.select(F.input_file_name()).distinct().collect()]
    assert read and all("risk_tier=CRITICAL" in f for f in read)


def test_streamed_scores_equal_batch_scores(spark, trained, accounts):
    base = new_path(spark, "stream-scores")
    accounts.write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(accounts.schema).parquet(f"{base}/in")
    stream_scores(arriving, trained[0], f"{base}/out", f"{base}/checkpoint").awaitTermination()
    streamed = spark.read.parquet(f"{base}/out").select("customerID", "probability", "risk_tier")
    batch = scoring.score(accounts, trained[0]).select("customerID", "probability", "risk_tier")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_importances_sum_to_one(spark, trained):
    rows = explaining.feature_importance(trained[0].pipeline, spark).collect()
    values = [r["Importance"] for r in rows]
    assert len(rows) == 45 and min(values) >= 0 and sum(values) == pytest.approx(1.0)
    assert values == sorted(values, reverse=True)


def test_logistic_has_no_tree_explanation(spark, trained, accounts):
    frame = training.prepare(accounts, SETTINGS)
    model = training.fit_and_predict(frame, frame.limit(1), lambda rows: {LOGISTIC: training.logistic(1.0, rows, 5)},
                                     SETTINGS, new_path(spark, "lr"))[LOGISTIC]
    with pytest.raises(AttributeError):
        explaining.feature_importance(model, spark)
    with pytest.raises(TypeError):
        explaining.explain(accounts, model)


def _paths(trees):
    """Of every leaf: its value, and of each feature on its path the interval and the share of the cover."""
    for tree in trees:
        for leaf in np.flatnonzero(tree["child"] < 0):
            path, node = {}, leaf
            while node > 0:
                path.setdefault(tree["feature"][node], (tree["low"][node], tree["high"][node], tree["share"][node]))
                node = tree["parent"][node]
            yield tree["value"][leaf], path


def _brute_force(trees, x, features):
    """Shapley values by definition: average marginal worth over all coalitions."""
    leaves = list(_paths(trees))
    used = sorted({f for _, path in leaves for f in path})

    def worth(known):
        return sum(value * prod(float(low < x[f] <= high) if f in known else share
                                for f, (low, high, share) in path.items()) for value, path in leaves)

    phi = np.zeros(features)
    m = len(used)
    for f in used:
        others = [u for u in used if u != f]
        for size in range(m):
            weight = factorial(size) * factorial(m - size - 1) / factorial(m)
            for group in combinations(others, size):
                phi[f] += weight * (worth({*group, f}) - worth(set(group)))
    return phi


def _random_tree(rng, depth, features):
    """Nodes as Spark stores them, with some features met again on a path."""
    rows = []

    def grow(level, cover):
        number = len(rows)
        rows.append(None)
        if level == depth or (level > 1 and rng.random() < 0.2):
            rows[number] = (number, -1, -1, cover, rng.normal(), -1, np.nan, True, False, np.nan, np.nan)
            return number
        name, part = int(rng.integers(features)), rng.uniform(0.1, 0.9)
        left = grow(level + 1, cover * part)
        right = grow(level + 1, cover * (1 - part))
        rows[number] = (number, left, right, cover, 0.0, name, rng.normal(), name % 3 > 0, bool(name % 2), np.nan, np.nan)
        return number

    grow(0, 100.0)
    return pd.DataFrame(rows, columns=["id", "leftChild", "rightChild", "cover", "prediction", "feature", "cut", "ordered",
                                       "zero_left", "positives", "weighed"])


@pytest.mark.parametrize("seed", range(6))
def test_shapley_values_of_random_trees(seed):
    rng = np.random.default_rng(seed)
    trees = [explaining.arranged(_random_tree(rng, depth, 6), 0.7, True) for depth in (0, 1, 4, 6)]
    x = rng.normal(size=(5, 6)).round()
    phi = explaining.contributions(trees, x)
    for row, mine in zip(x, phi):
        assert np.allclose(mine, _brute_force(trees, row, 6), atol=1e-12)


@pytest.mark.parametrize("kind", [BOOSTING, FOREST])
def test_explanations_equal_brute_force_and_add_up(spark, accounts, kind):
    columns = (["tenure", "MonthlyCharges"], ["Contract", "InternetService"])
    settings = training.quick_settings(numeric=tuple(columns[0]), categorical=tuple(columns[1]))
    frame = training.prepare(accounts, settings)
    build = {BOOSTING: lambda rows: training.boosting(4, 0.3, 3), FOREST: lambda rows: training.forest(3, 4)}[kind]
    model = training.fit_and_predict(frame, frame.limit(1), lambda rows: {kind: build(rows)}, settings,
                                     new_path(spark, "small"))[kind]
    few = accounts.orderBy("customerID").limit(6)
    names = preprocessing.feature_names(model)
    packed = explaining.packed_trees(spark, explaining.classifier_of(model)).orderBy("tree").collect()
    trees = [pickle.loads(r["packed"]) for r in packed]
    out = "rawPrediction" if kind == BOOSTING else "probability"
    rows = model.transform(typed_accounts(few)).select(
        "customerID", vector_to_array("features").alias("x"), vector_to_array(out)[1].alias("total")).collect()
    found = {}
    # a group for each tree: several passes add up
    for r in explaining.explain(few, model, group_bytes=1).collect():
        found.setdefault(r["customerID"], {})[r["feature"]] = r["shap"]
    for row in rows:
        expected = _brute_force(trees, row["x"], len(names))
        mine = [found[row["customerID"]][n] for n in names]
        assert np.allclose(mine, expected, atol=1e-9)
        assert explaining.base_value(trees) + sum(mine) == pytest.approx(row["total"], abs=1e-9)


@pytest.mark.parametrize("splits", [0, 1, 3, 12])
def test_rows_of_a_class_share_a_subtree(monkeypatch, splits):
    """Each class of rows meets each small subtree once, with the values each row gets alone."""
    rng = np.random.default_rng(splits)
    trees = [explaining.arranged(_random_tree(rng, depth, 6), 0.7, True) for depth in (0, 1, 4, 7, 7)]
    x = rng.normal(size=(4000, 6)).round(1)
    met, distinct = [], explaining._distinct

    def counting(keys, limit):
        met.append(len(distinct(keys, limit)[0]))
        return distinct(keys, limit)

    monkeypatch.setattr(explaining, "_distinct", counting)
    monkeypatch.setattr(explaining, "SUBTREE", splits)
    phi = explaining.contributions(trees, x)
    assert sum(met) < len(x) * sum(len(t["parent"]) for t in trees) / 5
    for row, mine in list(zip(x, phi))[:5]:
        assert np.allclose(mine, explaining.contributions(trees, row[None])[0], atol=1e-12)
        assert np.allclose(mine, _brute_force(trees, row, 6), atol=1e-12)


def test_blocks_of_batches_are_explained_in_order(spark, monkeypatch):
    """Blocks of several Arrow batches give each row its own values, and sums of earlier trees are kept."""
    rng = np.random.default_rng(1)
    trees = [explaining.arranged(_random_tree(rng, 5, 4), 1.0, True)]
    x = rng.normal(size=(50, 4))
    kind = pa.list_(pa.float64())
    parts = [pa.record_batch([pa.array(x[s:s + 7].tolist(), kind), pa.array((10 * x[s:s + 7]).tolist(), kind)], ["x", "phi"])
             for s in range(0, 50, 7)]
    monkeypatch.setattr(explaining, "CELLS", 60)
    out = list(explaining._adding(SimpleNamespace(value=trees))(iter([*parts[:2], parts[0][:0], *parts[2:]])))
    assert [len(p) for p in out] == [len(p) for p in parts]
    found = np.array([row for p in out for row in p.column("phi").to_pylist()])
    assert np.allclose(found, explaining.contributions(trees, x) + 10 * x, atol=1e-12)


def test_accounts_are_dealt_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 1000 * cores, numPartitions=1)
    assert explaining.dealt(rows, 45).rdd.getNumPartitions() == cores
    assert explaining.dealt(rows.limit(5), 45).rdd.getNumPartitions() == 1
    assert explaining.dealt(rows, explaining.CELLS // 250).rdd.getNumPartitions() == 4 * cores


def test_deep_paths_of_many_features():
    """A path of 30 different features: values add up, and equal features get equal values."""
    rows, cover = [], 1.0
    for level in range(30):
        left, right = 2 * level + 1, 2 * level + 2
        rows.append((2 * level, left, right, cover, 0.0, level, 0.5, True, False, np.nan, np.nan))
        rows.append((left, -1, -1, cover * 0.4, 0.0, -1, np.nan, True, False, np.nan, np.nan))
        cover *= 0.6
    rows.append((60, -1, -1, cover, 2.0, -1, np.nan, True, False, np.nan, np.nan))
    tree = explaining.arranged(pd.DataFrame(rows, columns=[
        "id", "leftChild", "rightChild", "cover", "prediction", "feature", "cut", "ordered", "zero_left", "positives",
        "weighed"]), 1.0, True)
    phi = explaining.contributions([tree], np.ones((1, 30)))[0]
    assert phi.sum() == pytest.approx(2.0 - 2.0 * 0.6**30) and np.allclose(phi, phi[0], rtol=1e-12)


def test_tree_groups_have_a_size_bound():
    assert explaining.tree_groups([(0, 5), (1, 5), (2, 1), (3, 20), (4, 1)], 10) == [[0, 1], [2], [3], [4]]
    assert explaining.tree_groups([], 10) == []


def test_renewal_scores_every_customer(spark):
    from keepwell.plans import renewal

    rows = [(k, float(k % 100), k % 9, float(k % 11)) for k in range(60)] + [(60, None, 1, 5.0), (61, 40.0, None, None)]
    customers = spark.createDataFrame(rows, "id long, usage double, tickets int, nps double")
    model = renewal.train_renewal(renewal.with_renewal_label(customers), trees=5, depth=4)
    found = {r.id: r for r in renewal.score_renewal(customers, model).collect()}
    assert len(found) == 62 and found[5].renewal_probability is not None
    for missing in (60, 61):
        assert found[missing].renewal_probability is None and found[missing].risk_level is None
        assert found[missing].recommendation is None


def test_big_tables_are_dealt_out_and_small_ones_left(spark, monkeypatch):
    """Tasks of training grow in number with the table, whatever the files are; no row is lost or repeated."""
    rows = spark.createDataFrame([(f"c{i % 90}", "Yes" if i % 3 else "No", float(i)) for i in range(100)],
                                 "customerID string, Churn string, tenure double").coalesce(1)
    settings = training.quick_settings(numeric=("tenure",), categorical=())
    small = training.prepare(rows, settings)
    assert small.rdd.getNumPartitions() == 1
    monkeypatch.setattr(training, "TASK_ROWS", 10)
    big = training.prepare(rows, settings)
    assert big.rdd.getNumPartitions() == 10
    assert max(big.rdd.glom().map(len).collect()) <= 11
    assert sorted(map(tuple, big.collect())) == sorted(map(tuple, small.collect()))


def test_fits_side_by_side_hold_a_bounded_number_of_rows():
    settings = training.quick_settings()
    assert training.side_by_side(settings, 1000) == (3, 3)
    for rows in (0, 800_000, 3_000_000, 5_000_000, 36_000_000):
        folds, fits = training.side_by_side(settings, rows)
        assert folds >= 1 and fits >= 1
        assert folds * fits == 1 or folds * fits * rows <= training.ROWS_AT_ONCE


def test_champion_keeps_the_fits_of_its_search(spark, accounts, monkeypatch):
    """The winner's folds are not fitted twice, and come out as if they were."""
    fits, whole = [], training.boosting

    def counted(*args, **kwargs):
        made = whole(*args, **kwargs)
        fit = made.fit
        made.fit = lambda *a, **k: fits.append(1) or fit(*a, **k)
        return made

    monkeypatch.setattr(training, "boosting", counted)
    found = {}
    for limit in (training.KEPT_NODES, 0):
        monkeypatch.setattr(training, "KEPT_NODES", limit)
        fits.clear()
        champion, oof, _ = training.train_champion(
            accounts, SETTINGS, new_path(spark, "champion"), [BOOSTING], {BOOSTING: SPACE})
        found[limit] = (len(fits), champion.threshold, sorted(map(tuple, oof.select(
            "fold", "customerID", "probability").collect())))
    kept, again = found.values()
    assert (kept[0], again[0]) == (SETTINGS.folds + 1, 2 * SETTINGS.folds + 1)
    assert kept[1:] == again[1:]


def test_deep_forest_is_sparks_tree(spark, monkeypatch):
    """Without draws both must be the same, whether nodes are split by all tasks or below one."""
    rows = [(float((k * 7919 % 101 < 50) != (k % 13 == 4)), 1.0 + k % 2, [k % 2 * 1.0, k * 31 % 29 / 2, k * 17 % 23 * 1.0, 5.0, k * 7 % 3 * 1.0])
            for k in range(3000)]
    table = spark.createDataFrame(rows, "label double, weight double, x array<double>").select("label", "weight", array_to_vector("x").alias("features"))
    for leaf in (1, 6):
        wanted = training.forest(1, None, leaf, None).setBootstrap(False)
        theirs = wanted.fit(table)
        for limit in (10**6, 400):
            monkeypatch.setattr(forests, "LOCAL_ROWS", limit)
            mine = forests.DeepForest(wanted).fit(table)
            assert mine.totalNumNodes == theirs.totalNumNodes > 100 and mine.getMaxDepth() == 30
            assert np.array([r.probability.toArray() for r in mine.transform(table).collect()]) == pytest.approx(np.array([r.probability.toArray() for r in theirs.transform(table).collect()]))
            assert mine.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray())


def test_deep_forests_on_many_rows_are_not_fitted_level_by_level(spark, monkeypatch):
    drawn = {"n_estimators": 5, "max_depth": None, "min_samples_leaf": 1, "max_features": "sqrt"}
    settings = training.quick_settings()
    assert isinstance(training.tuned(FOREST, drawn, settings, 10**6), forests.DeepForest)
    assert not isinstance(training.tuned(FOREST, drawn | {"max_depth": 5}, settings, 10**6), forests.DeepForest)
    full = training.candidates(training.TrainingSettings(), 10**6)[FOREST]
    assert isinstance(full, forests.DeepForest) and full.like.getNumTrees() == 300
    chance = np.random.RandomState(2)
    x = chance.randn(4000, 6)
    rows = [(float(v[0] + v[1] * v[2] > chance.randn() / 2), 1.0, v.tolist()) for v in x]
    table = spark.createDataFrame(rows, "label double, weight double, x array<double>").select("label", "weight", array_to_vector("x").alias("features"))
    monkeypatch.setattr(forests, "LOCAL_ROWS", 700)
    forest = training.forest(12, None)
    areas = [roc_auc(training._probability(m, table).select("label", "probability")).first()["roc_auc"]
             for m in (forests.DeepForest(forest).fit(table), forest.fit(table))]
    assert areas == pytest.approx([1, 1], abs=0.01)
    again = [forests.DeepForest(forest).fit(table).toDebugString for _ in range(2)]
    assert again[0].split("\n")[1:] == again[1].split("\n")[1:]


def test_champion_reads_the_deep_forests_of_its_search(spark, accounts, monkeypatch):
    fitted, fit = [], forests.DeepForest.fit
    monkeypatch.setattr(training, "DEEP_ROWS", 100)
    monkeypatch.setattr(training, "KEPT_NODES", 0)
    monkeypatch.setattr(forests.DeepForest, "fit", lambda self, train: fitted.append(1) or fit(self, train))
    space = {"n_estimators": [3], "max_depth": [None], "min_samples_leaf": [1], "max_features": [None]}
    champion, oof, _ = training.train_champion(accounts, SETTINGS, new_path(spark, "deep"), [FOREST], {FOREST: space})
    assert len(fitted) == SETTINGS.folds + 1  # and not two a fold
    assert oof.count() == training.training_rows(training.prepare(accounts, SETTINGS)).count()
    assert champion.cv_roc_auc == pytest.approx(sum(r["roc_auc"] for r in roc_auc(oof, ("fold",)).collect()) / SETTINGS.folds)


def test_binned_boosting_is_sparks(spark, monkeypatch):
    """Without draws both must be the same, whether one task grows all trees or each level is a scan."""
    chance = np.random.RandomState(3)
    x = chance.randint(0, [2, 29, 23, 1, 7], (3000, 5)).astype(float)
    rows = [(float(v[0] * 8 + v[1] - v[2] * v[4] / 4 > 9 * chance.randn()), v.tolist()) for v in x]
    table = spark.createDataFrame(rows, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    scores = lambda model: [r.probability[1] for r in model.transform(table).select("probability").collect()]
    for depth, leaf in ((3, 1), (5, 60)):
        own = training.boosting(10, 0.1, depth, leaf)
        theirs = own.fit(table)
        for limit in (10**6, 10):
            monkeypatch.setattr(boosted, "LOCAL_ROWS", limit)
            mine = boosted.BinnedBoosting(own).fit(table)
            assert (mine.totalNumNodes, mine.treeWeights) == (theirs.totalNumNodes, theirs.treeWeights)
            assert (mine.getMaxIter(), mine.getMaxDepth(), mine.getMinInstancesPerNode()) == (10, depth, leaf)
            assert scores(mine) == pytest.approx(scores(theirs))
            assert mine.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray())


def test_binned_boosting_draws_by_row_number(spark, monkeypatch):
    chance = np.random.RandomState(5)
    rows = [(float(v[0] + v[1] * v[2] > chance.randn() / 2), v.tolist()) for v in chance.randn(3000, 4)]
    table = spark.createDataFrame(rows, "label double, x array<double>").select("label", array_to_vector("x").alias("features")).repartition(5).persist()
    own = training.boosting(20, 0.2, 3, 4, 0.7)
    areas, told = [], []
    for limit in (10**6, 10):
        monkeypatch.setattr(boosted, "LOCAL_ROWS", limit)
        model = boosted.BinnedBoosting(own).fit(table)
        areas.append(roc_auc(training._probability(model, table).select("label", "probability")).first()["roc_auc"])
        told.append(model.featureImportances.toArray())
    areas.append(roc_auc(training._probability(own.fit(table), table).select("label", "probability")).first()["roc_auc"])
    assert areas[0] == pytest.approx(areas[1], abs=1e-9) and told[0] == pytest.approx(told[1])
    assert areas[0] == pytest.approx(areas[2], abs=0.02)


def test_large_boosted_models_are_not_sparks():
    drawn = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "min_samples_leaf": 1, "subsample": 0.7}
    settings = training.quick_settings()
    assert isinstance(training.tuned(BOOSTING, drawn, settings, 100), boosted.BinnedBoosting)
    assert isinstance(training.tuned(BOOSTING, drawn | {"n_estimators": 5}, settings, 10**6), boosted.BinnedBoosting)
    assert not isinstance(training.tuned(BOOSTING, drawn | {"n_estimators": 5}, settings, 100), boosted.BinnedBoosting)
    assert isinstance(training.candidates(training.TrainingSettings(), 100)[BOOSTING], boosted.BinnedBoosting)


def test_searches_of_the_queries_are_whole(spark, monkeypatch):
    """Five folds, and all draws out of the published spaces."""
    asked = []
    monkeypatch.setattr(learn, "uploaded", lambda *_: None)
    monkeypatch.setattr(training, "prepare", lambda accounts, settings: None)
    monkeypatch.setattr(training, "tuning_summary", lambda spark, results: None)
    monkeypatch.setattr(training, "random_search", lambda frame, settings, kinds=None, spaces=None, *_: asked.append((settings, kinds, spaces)))
    monkeypatch.setattr(training, "train_champion", lambda accounts, settings, path, kinds=None, spaces=None, *_: asked.append((settings, kinds, spaces)))
    monkeypatch.setattr(learn, "load_champion", lambda *_: None)
    monkeypatch.setattr(learn, "measured", lambda *_: None)
    learn.i16(spark, "no folder")
    learn.i17_boosted(spark, "no folder")
    whole = training.TrainingSettings()
    for settings, kinds, spaces in asked:
        assert training.replace(settings, fold_parallelism=whole.fold_parallelism) == whole and spaces is None
    assert [list(kinds or whole.draws) for _, kinds, _ in asked] == [[LOGISTIC, FOREST, BOOSTING], [BOOSTING]]
    drawn = training.draw_all(asked[0][0], asked[0][1], asked[0][2])
    assert len(drawn) == 58 and all(d["n_estimators"] >= 100 for kind, d in drawn.values() if kind != LOGISTIC)


def test_deep_forest_is_not_loaded_by_the_driver(spark, accounts, monkeypatch):
    """Fitted, scored, saved, loaded and explained from its files, in groups of trees; as Spark's model of the same files scores."""
    monkeypatch.setattr(training, "DEEP_ROWS", 100)
    real = forests.RandomForestClassificationModel
    monkeypatch.setattr(forests, "RandomForestClassificationModel", None)
    space = {"n_estimators": [4], "max_depth": [None], "min_samples_leaf": [1], "max_features": ["sqrt"]}
    path = new_path(spark, "deep")
    champion, oof, _ = training.train_champion(accounts, SETTINGS, path, [FOREST], {FOREST: space})
    loaded = load_champion(spark, path)
    forest = explaining.classifier_of(loaded.pipeline)
    assert isinstance(forest, forests.StoredForest) and (forest.getNumTrees, loaded.threshold) == (4, champion.threshold)

    def scores(pipeline):
        scored = pipeline.transform(typed_accounts(accounts)).select("customerID", "rawPrediction", "probability", "prediction")
        return {r[0]: (*r[1], *r[2], r[3]) for r in scored.collect()}

    first = scores(loaded.pipeline)
    assert scores(champion.pipeline) == first
    monkeypatch.setattr(forests, "GROUP_BYTES", 1)
    monkeypatch.setattr(forests, "TASK_BYTES", 1)
    assert len(forest.groups(1)) == 4 and len(forest.groups(10**9)) == 1
    grouped = scores(loaded.pipeline)
    theirs = scores(PipelineModel(stages=[*preprocessing.flat_stages(loaded.pipeline)[:-1], real.load(forest.path)]))
    for found in (grouped, theirs):
        assert found.keys() == first.keys() and [*found.values()] == [pytest.approx(first[k]) for k in found]
    assert forest.featureImportances.toArray() == pytest.approx(real.load(forest.path).featureImportances.toArray())
    explained = explaining.explain(accounts, loaded.pipeline).groupBy("customerID").agg((F.sum("shap") + F.max("base")).alias("p"))
    assert {r[0]: r[1] for r in explained.collect()} == pytest.approx({k: v[3] for k, v in first.items()})


def test_deep_forests_of_many_trees_are_not_on_the_driver():
    assert isinstance(training.forest(500, None, rows=10_000), forests.DeepForest)
    assert not isinstance(training.forest(10, None, rows=10_000), forests.DeepForest)
    assert not isinstance(training.forest(500, 8, rows=10_000), forests.DeepForest)
