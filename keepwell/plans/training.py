"""Training, comparing, tuning and choosing churn models."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from math import prod
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell import domain
from keepwell.domain import BOOSTING, FOREST, LOGISTIC, SEED
from keepwell.functions.values import hash_bucket
from keepwell.operators.cleaning import drop_unlabelled, typed_accounts
from keepwell.operators.evaluation import FINE_GRID, best_threshold, evaluate, roc_auc, threshold_sweep
from keepwell.operators.ordering import hashed_rank
from keepwell.plans.boosted import BinnedBoosting
from keepwell.plans.forests import DeepForest, StoredForest
from keepwell.plans.preprocessing import FEATURES, Side, fitted, learn_sides
from keepwell.session import new_path
from keepwell.sources.champion import Champion, save_champion

KEY = "customerID"
MAX_DEPTH = 30  # the deepest tree Spark grows; stands for "no limit"
TASK_ROWS = 200_000  # rows that one task reads of the training table
ROWS_AT_ONCE = 8_000_000  # training rows that fits side by side may hold together
DEEP, DEEP_ROWS = 10, 50_000  # a forest beyond this depth, on more rows than this, is not fitted by Spark's own
DEEP_DRAWN = 1_000_000  # or where all its trees together draw more: the driver would hold their nodes
MANY_TREES = 50  # nor is a boosted model of more trees, or on more than DEEP_ROWS
KEPT_NODES = 1_000_000  # tree nodes of the search's models that are kept for the champion


@dataclass(frozen=True)
class TrainingSettings:
    """How much to train. The defaults are the full comparison and search; tests pass smaller numbers."""

    folds: int = 5
    test_share: float = 0.2
    seed: int = SEED
    logistic_iterations: int = 2000
    logistic_c: float = 1.0
    forest_trees: int = 300
    forest_depth: int = MAX_DEPTH
    boosting_trees: int = 150
    boosting_rate: float = 0.05
    boosting_depth: int = 3
    draws: dict[str, int] = field(default_factory=lambda: {LOGISTIC: 8, FOREST: 25, BOOSTING: 25})
    parallelism: int = 3  # classifiers fitted at once on one fold, while ROWS_AT_ONCE allows
    fold_parallelism: int = 1  # folds at once, likewise; each keeps its own features persisted
    partitions: int | None = None  # spreads small training sets over more tasks; big ones are spread already
    numeric: tuple[str, ...] = tuple(domain.NUMERIC_FEATURES)
    categorical: tuple[str, ...] = tuple(domain.CATEGORICAL_FEATURES)


# ---- splits and weights -------------------------------------------------------------------------
def assign_split(df: DataFrame, key: str = KEY, label: str = "label", test: float = 0.2, seed: int = SEED,
                 exact: bool = False) -> DataFrame:
    """Adds `split`: train / test by the hash of the key, no shuffle; class shares hold approximately.

    `exact` takes the same share of every class instead, by hash rank within the class.
    """
    if not exact:
        is_test = hash_bucket(key, 100, seed) < round(test * 100)
    else:
        df = hashed_rank(df, key, [label], seed)
        is_test = F.col("_rank") < F.round(F.col("_size") * test)
    return df.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train"))).drop("_rank", "_size")


def assign_folds(df: DataFrame, k: int = 5, key: str = KEY, label: str = "label", seed: int = SEED,
                 exact: bool = False) -> DataFrame:
    """Adds `fold` in [0, k), by the hash of the key, or dealt in turn within each class when `exact`."""
    if not exact:
        return df.withColumn("fold", hash_bucket(key, k, seed).cast("int"))
    ranked = hashed_rank(df, key, [label], seed)
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_size")


def label_weights(df: DataFrame) -> DataFrame:
    """(label, weight) with weight n / (2 n_c): two rows."""
    total = df.agg(F.count("label").cast("double").alias("n"))
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    return counts.select("label", F.try_divide(total.scalar(), F.col("n_c") * 2.0).alias("weight"))


def class_weights(df: DataFrame) -> DataFrame:
    """Labelled rows with their balanced class weight; the joined side has one row per class."""
    return df.join(F.broadcast(label_weights(df)), "label")


def prepare(accounts: DataFrame, settings: TrainingSettings) -> DataFrame:
    """Labelled, typed, split and folded accounts: only the columns training reads.

    A big table is dealt out, so that its tasks grow in number and not in size.
    """
    frame = drop_unlabelled(typed_accounts(accounts)).select(
        KEY, "label", *settings.numeric, *settings.categorical)
    frame = spread(frame, accounts.count())
    frame = assign_split(frame, test=settings.test_share, seed=settings.seed)
    return assign_folds(frame, settings.folds, seed=settings.seed)


def spread(df: DataFrame, rows: int, task_rows: int | None = None) -> DataFrame:
    """The table in at least one partition per `task_rows` of its `rows`; as it is, if it has so many."""
    wanted = -(-rows // (task_rows or TASK_ROWS))
    return df.repartition(wanted) if wanted > max(1, df.rdd.getNumPartitions()) else df


# ---- candidates ---------------------------------------------------------------------------------
def logistic(c: float, rows: float, iterations: int) -> LogisticRegression:
    """An L2 penalty of 1/C on the summed loss is 1/(C n) on the mean loss, balanced weights summing to n."""
    return LogisticRegression(featuresCol=FEATURES, labelCol="label", weightCol="weight", maxIter=iterations,
                              standardization=False, regParam=1.0 / (c * max(rows, 1.0)), elasticNetParam=0.0)


def forest(trees: int, depth: int | None, leaf: int = 1, features: str | None = "sqrt", seed: int = SEED,
           rows: float = 0) -> RandomForestClassifier | DeepForest:
    """A deep forest on many rows is grown by `DeepForest`, as Spark's own reads all rows again for every few nodes.

    So is one of many trees, as the driver would hold all nodes of Spark's.
    """
    own = RandomForestClassifier(
        featuresCol=FEATURES, labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth or MAX_DEPTH,
        minInstancesPerNode=leaf, featureSubsetStrategy=features or "all", seed=seed, maxMemoryInMB=512)
    many = rows > DEEP_ROWS or rows * trees > DEEP_DRAWN
    return DeepForest(own) if many and own.getMaxDepth() > DEEP else own


def boosting(trees: int, rate: float, depth: int, leaf: int = 1, subsample: float = 1.0,
             seed: int = SEED, rows: float = 0) -> GBTClassifier | BinnedBoosting:
    """Many trees, or trees of many rows, are grown by `BinnedBoosting`: Spark starts jobs for each tree and keeps each row as an object."""
    own = GBTClassifier(featuresCol=FEATURES, labelCol="label", maxIter=trees, stepSize=rate, maxDepth=depth,
                        minInstancesPerNode=leaf, subsamplingRate=subsample, seed=seed, maxMemoryInMB=512)
    return BinnedBoosting(own) if trees > MANY_TREES or rows > DEEP_ROWS else own


def candidates(settings: TrainingSettings, rows: float) -> dict[str, Estimator]:
    """The three compared classifiers, for a training set of `rows` rows."""
    return {
        LOGISTIC: logistic(settings.logistic_c, rows, settings.logistic_iterations),
        FOREST: forest(settings.forest_trees, settings.forest_depth, seed=settings.seed, rows=rows),
        BOOSTING: boosting(settings.boosting_trees, settings.boosting_rate, settings.boosting_depth,
                           seed=settings.seed, rows=rows),
    }


def draw(space: dict[str, list], n: int, seed: int = SEED) -> list[dict]:
    """n different combinations of a search space, in a seeded order; all of them when n covers the space."""
    names, sizes = list(space), [len(v) for v in space.values()]
    picked = random.Random(seed).sample(range(prod(sizes)), min(n, prod(sizes)))
    combinations = []
    for index in picked:
        chosen = {}
        for name, size in zip(names, sizes):
            index, place = divmod(index, size)
            chosen[name] = space[name][place]
        combinations.append(chosen)
    return combinations


def tuned(kind: str, drawn: dict, settings: TrainingSettings, rows: float) -> Estimator:
    """A classifier of one kind with drawn parameters."""
    if kind == LOGISTIC:
        return logistic(drawn["C"], rows, max(settings.logistic_iterations, 3000))
    if kind == FOREST:
        return forest(drawn["n_estimators"], drawn["max_depth"], drawn["min_samples_leaf"], drawn["max_features"],
                      settings.seed, rows)
    return boosting(drawn["n_estimators"], drawn["learning_rate"], drawn["max_depth"], drawn["min_samples_leaf"],
                    drawn["subsample"], settings.seed, rows)


# ---- fitting ------------------------------------------------------------------------------------
def fold_sides(frame: DataFrame, settings: TrainingSettings) -> list[Side]:
    """What preprocessing learns without each fold in turn, and at last from all rows; one scan serves them all."""
    folds = range(settings.folds)
    sides = [[p for p in folds if p != fold] for fold in folds] + [list(folds)]
    return learn_sides(frame, settings.numeric, settings.categorical, sides, F.col("fold"), settings.folds, "label")


def _with_weight(train: DataFrame, side: Side) -> DataFrame:
    """Balanced weights from the class counts."""
    weight = F.lit(0.0)
    for label, count in side.labels.items():
        share = F.lit(sum(side.labels.values()) / (2.0 * count))
        weight = F.when(F.col("label") == int(label), share).otherwise(weight)
    return train.withColumn("weight", weight)


def _probability(model: Model, features: DataFrame) -> DataFrame:
    return model.transform(features).withColumn("probability", vector_to_array("probability")[1])


@contextmanager
def _features(train: DataFrame, test: DataFrame, settings: TrainingSettings,
              side: Side | None) -> Iterator[tuple[PipelineModel, DataFrame, DataFrame, float]]:
    """Fitted preprocessing, the persisted features of both sides, and the number of training rows."""
    side = side or learn_sides(train, settings.numeric, settings.categorical, [[0]], label="label")[0]
    prepared = fitted(train.sparkSession, side)
    train_features = prepared.transform(_with_weight(train, side)).select("label", "weight", FEATURES)
    if settings.partitions:
        train_features = train_features.repartition(settings.partitions)
    train_features = train_features.persist(StorageLevel.MEMORY_AND_DISK)
    test_features = prepared.transform(test).select(KEY, "label", FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield prepared, train_features, test_features, float(sum(side.labels.values()))
    finally:
        train_features.unpersist()
        test_features.unpersist()


def fit_and_predict(train: DataFrame, test: DataFrame, build, settings: TrainingSettings, path: str,
                    side: Side | None = None, known: Mapping[str, Model | str] | None = None, **tags) -> dict[str, PipelineModel]:
    """Fits every classifier on `train` and stores the predictions on `test` under `path`.

    `known` are classifiers that have been fitted on just these rows and settings, by name, or paths of stored forests; they are not fitted again.

    `build(rows)` gives the classifiers by name; `side` is what preprocessing has learned from `train`, if it has. The
    assembled features are persisted while the classifiers read them; predictions are written out, so no lineage grows
    over folds. Independent fits run from driver threads, each writing its own `run` folder below the folders of `tags`,
    which read back as columns.
    """
    folder = "/".join([path, *[f"{k}={v}" for k, v in tags.items()]])
    with _features(train, test, settings, side) as (prepared, train_features, test_features, rows):

        def run(item: tuple[int, tuple[str, Estimator]]) -> tuple[str, PipelineModel]:
            number, (name, estimator) = item
            model = (known or {}).get(name) or estimator.fit(train_features)
            if isinstance(model, str):
                model = StoredForest(model)
            _probability(model, test_features).select(
                F.lit(name).alias("model"), KEY, "label", "probability").write.parquet(f"{folder}/run={number}")
            return name, PipelineModel(stages=[prepared, model])

        threads = side_by_side(settings, rows)[1]
        return dict(_at_once(train.sparkSession, threads, run, enumerate(build(rows).items())))


def side_by_side(settings: TrainingSettings, rows: float) -> tuple[int, int]:
    """How many folds, and classifiers of each, are fitted at once on `rows` training rows each.

    Every fit keeps its own copy of its rows, so that together they would outgrow the memory and be read from disk in
    each pass.
    """
    fits = max(1, int(ROWS_AT_ONCE // max(rows, 1)))
    folds = min(settings.fold_parallelism, fits)
    return folds, min(settings.parallelism, fits // folds)


def _at_once(spark: SparkSession, threads: int, work, items) -> list:
    """Runs independent Spark jobs from a few driver threads."""
    with ThreadPool(threads) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """The rows, persisted while several jobs read them."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def oof_predictions(frame: DataFrame, build, settings: TrainingSettings, path: str | None = None,
                    sides: Sequence[Side] | None = None, known: Mapping[int, Mapping[str, Model | str]] | None = None) -> DataFrame:
    """(model, fold, customerID, label, probability): every row predicted by models that never saw its fold.

    `known` are classifiers that have been fitted without a fold already, by fold and name.
    """
    spark = frame.sparkSession
    path = path or new_path(spark, "oof")
    with kept(frame) as frame:
        learned = sides or fold_sides(frame, settings)

        def run(fold: int) -> None:
            fit_and_predict(frame.where(F.col("fold") != fold), frame.where(F.col("fold") == fold), build, settings,
                            path, learned[fold], (known or {}).get(fold), fold=fold)

        _at_once(spark, _folds_at_once(settings, learned), run, range(settings.folds))
    return spark.read.parquet(path).drop("run")


def _folds_at_once(settings: TrainingSettings, sides: Sequence[Side]) -> int:
    return side_by_side(settings, max(side.rows for side in sides[:settings.folds]))[0]


def training_rows(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("split") == "train")


def cross_validate(frame: DataFrame, settings: TrainingSettings, build=None) -> DataFrame:
    """(model, roc_auc, average_precision, precision, recall, f1): means over the folds of the training rows."""
    build = build or (lambda rows: candidates(settings, rows))
    return fold_means(oof_predictions(training_rows(frame), build, settings))


def fold_means(oof: DataFrame) -> DataFrame:
    metrics = ["roc_auc", "average_precision", "precision", "recall", "f1"]
    return evaluate(oof, 0.5, ("model", "fold")).groupBy("model").agg(*[F.avg(m).alias(m) for m in metrics])


def holdout(frame: DataFrame, settings: TrainingSettings, path: str | None = None) -> DataFrame:
    """(model, accuracy, roc_auc, average_precision, precision, recall, f1) on the test rows."""
    return evaluate(holdout_predictions(frame, settings, path), 0.5, ("model",))


def holdout_predictions(frame: DataFrame, settings: TrainingSettings, path: str | None = None) -> DataFrame:
    spark = frame.sparkSession
    path = path or new_path(spark, "holdout")
    with kept(frame) as frame:
        fit_and_predict(training_rows(frame), frame.where(F.col("split") == "test"),
                        lambda rows: candidates(settings, rows), settings, path)
    return spark.read.parquet(path).drop("run")


# ---- search and champion ------------------------------------------------------------------------
@dataclass(frozen=True)
class SearchResult:
    name: str
    kind: str
    settings: dict
    cv_roc_auc: float


def draw_all(settings: TrainingSettings, kinds: Sequence[str] | None = None,
             spaces: dict[str, dict] | None = None) -> dict[str, tuple[str, dict]]:
    """The combinations to try, by name: (kind of classifier, drawn parameters)."""
    known = {LOGISTIC: domain.LOGISTIC_SPACE, FOREST: domain.FOREST_SPACE, BOOSTING: domain.BOOSTING_SPACE}
    return {
        f"{kind} {i}": (kind, drawn)
        for kind in kinds or settings.draws
        for i, drawn in enumerate(draw((spaces or {}).get(kind) or known[kind], settings.draws[kind], settings.seed))}


TRIAL = "trial string, name string, kind string, settings string, fold int, roc_auc double"


def trial_key(kind: str, drawn: dict, fold: int, settings: TrainingSettings, side: Side) -> str:
    """Names one fit of a search: the same draw, fold, columns and class counts have the same name."""
    told = [kind, drawn, fold, settings.folds, settings.test_share, settings.seed, settings.logistic_iterations,
            settings.numeric, settings.categorical, side.labels]
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:32]


def read_trials(spark: SparkSession, ledger: str) -> dict[str, float | None]:
    """ROC-AUC by trial, of all that the ledger holds: one short row a fit."""
    try:
        table = spark.read.schema(TRIAL).option("recursiveFileLookup", "true").parquet(ledger)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["trial"]: r["roc_auc"] for r in table.select("trial", "roc_auc").collect()}


def random_search(frame: DataFrame, settings: TrainingSettings, kinds: Sequence[str] | None = None,
                  spaces: dict[str, dict] | None = None, ledger: str | None = None,
                  sides: Sequence[Side] | None = None,
                  models: dict[tuple[str, int], Model | str] | None = None) -> list[SearchResult]:
    """The mean ROC-AUC of every draw over the folds of the training rows.

    Each fit writes its metric into `ledger`, a folder in shared storage, as soon as it is done; a search that is started
    again with the same ledger, table and settings goes on where it ended. A fold's features are persisted once for all
    its draws. Predictions are only measured, not stored. `models` takes the fitted classifiers by draw and fold, up to
    KEPT_NODES tree nodes; of deep forests, which are stored, only the path.
    """
    spark, rows = frame.sparkSession, training_rows(frame)
    drawn = draw_all(settings, kinds, spaces)
    ledger = ledger or new_path(spark, "trials")
    nodes = [0]
    with kept(rows) as rows:
        learned = sides or fold_sides(rows, settings)
        keys = {(name, fold): trial_key(kind, d, fold, settings, learned[fold])
                for name, (kind, d) in drawn.items() for fold in range(settings.folds)}
        done = read_trials(spark, ledger)

        def search(fold: int) -> None:
            pending = [name for name in drawn if keys[name, fold] not in done]
            if not pending:
                return
            train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
            with _features(train, test, settings, learned[fold]) as (_, train_features, test_features, n):

                def attempt(name: str) -> None:
                    (kind, d), key = drawn[name], keys[name, fold]
                    model = (estimator := tuned(kind, d, settings, n)).fit(train_features)
                    if models is not None and (saved := getattr(estimator, "saved", None)):
                        models[name, fold] = saved
                    elif models is not None and nodes[0] + (size := getattr(model, "totalNumNodes", 1)) <= KEPT_NODES:
                        nodes[0] += size
                        models[name, fold] = model
                    with kept(_probability(model, test_features).select("label", "probability")) as scored:
                        measured = roc_auc(scored).first()
                    row = (key, name, kind, json.dumps(d), fold, measured["roc_auc"] if measured else None)
                    # a folder for each trial, so that fits at the same time don't meet and a repeated one replaces its own
                    spark.createDataFrame([row], TRIAL).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/trial={key}")

                _at_once(spark, side_by_side(settings, n)[1], attempt, pending)

        _at_once(spark, _folds_at_once(settings, learned), search, range(settings.folds))
    done = read_trials(spark, ledger)

    def mean(name: str) -> float:
        found = [v for fold in range(settings.folds) if (v := done[keys[name, fold]]) is not None]
        return sum(found) / len(found) if found else 0.0

    return [SearchResult(name, kind, d, mean(name)) for name, (kind, d) in drawn.items()]


def tuning_summary(spark: SparkSession, results: Sequence[SearchResult]) -> DataFrame:
    """(model, roc_auc, settings): the best draw of every kind, best kind first."""
    best = [select_champion(results, kind) for kind in dict.fromkeys(r.kind for r in results)]
    rows = [(r.kind, float(r.cv_roc_auc), str(r.settings)) for r in best]
    return spark.createDataFrame(rows, "model string, roc_auc double, settings string").orderBy(
        F.desc("roc_auc"), "model")


def select_champion(results: Sequence[SearchResult], choose: str | None = None) -> SearchResult:
    """The draw with the best mean ROC-AUC, of one kind if asked; the earlier draw on ties."""
    return max((r for r in results if choose in (None, r.kind)), key=lambda r: r.cv_roc_auc)


def champion_threshold(oof: DataFrame) -> float:
    """The threshold with the best out-of-fold F1, from a sweep over 0.10 to 0.70."""
    return best_threshold(threshold_sweep(oof, FINE_GRID)).first()["threshold"]


def train_champion(accounts: DataFrame, settings: TrainingSettings, path: str, kinds: Sequence[str] | None = None,
                   spaces: dict[str, dict] | None = None, choose: str | None = None,
                   ledger: str | None = None) -> tuple[Champion, DataFrame, DataFrame]:
    """Searches, chooses, sets the threshold out of fold, fits on the training rows and saves.

    Returns the champion, its out-of-fold predictions and its predictions on the test rows; those of other draws are not
    stored. With a `ledger` of an unfinished search, that search goes on. The winner's models of the folds are the
    search's own, as far as it has kept them.
    """
    spark = accounts.sparkSession
    with kept(prepare(accounts, settings)) as frame:
        rows = training_rows(frame)
        sides = fold_sides(rows, settings)
        models: dict[tuple[str, int], Model | str] = {}
        results = random_search(frame, settings, kinds, spaces, ledger, sides, models)
        winner = select_champion(results, choose)

        def build(n: float) -> dict[str, Estimator]:
            return {winner.kind: tuned(winner.kind, winner.settings, settings, n)}

        known = {fold: {winner.kind: model} for (name, fold), model in models.items() if name == winner.name}
        oof = oof_predictions(rows, build, settings, sides=sides, known=known)
        tested = new_path(spark, "champion-holdout")
        model = fit_and_predict(rows, frame.where(F.col("split") == "test"), build, settings, tested, sides[-1])
        champion = Champion(model[winner.kind], winner.kind, champion_threshold(oof), winner.cv_roc_auc)
        save_champion(spark, champion, path)
        return champion, oof, spark.read.parquet(tested).drop("run")


def quick_settings(**changes) -> TrainingSettings:
    """Small models for tests and timing; every row is still trained on and predicted."""
    small = TrainingSettings(folds=3, fold_parallelism=3, logistic_iterations=50, forest_trees=10, forest_depth=5,
                             boosting_trees=10, boosting_rate=0.1, draws={LOGISTIC: 2, FOREST: 2, BOOSTING: 2})
    return replace(small, **changes)
