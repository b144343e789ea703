"""Gradient-boosted trees on binned rows.

Spark's own boosting keeps every row as an object, and starts several jobs for each tree however few rows there are. Here
rows are sorted into bins once for all fits on them, and stored in blocks. Of few rows one task grows all trees. Of many,
each level of a tree is one scan, whose sums come to the driver: a few kilobytes a task. The margins of the trees so far
are stored every few trees. Loss, weights, gains and stops are Spark's, and so is the model, read from files in its format.
"""

from __future__ import annotations

import json
import sys
import threading
from collections.abc import Iterator
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keepwell.plans import forests
from keepwell.plans.forests import EPSILON, feature_thresholds, scrambled
from keepwell.session import new_path, stored

LOCAL_ROWS = 1_000_000  # training rows up to which one task grows all trees; it holds about 150 bytes a row
BLOCK_ROWS = 8192  # rows of a stored block
MARGINS_EVERY = 8  # trees after which the margins are stored
DEEPEST = 10  # levels whose sums are gathered on the driver
BLOCK = "row binary, label binary, margin binary, bins binary"
NODES = ("tree int, id int, left int, right int, feature int, threshold double, gain double, impurity double, "
         "prediction double, rows double, total double, squares double")

# tasks get this module's functions with the job, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(forests)


class Cuts:
    """All places where a row's features may be cut, feature by feature."""

    def __init__(self, thresholds: list[np.ndarray]):
        self.thresholds = thresholds
        self.sizes = [len(t) + 1 for t in thresholds]
        self.feature = np.repeat(np.arange(len(thresholds)), [len(t) for t in thresholds])
        self.cut = np.concatenate([np.arange(len(t)) for t in thresholds]) if thresholds else np.zeros(0, np.int64)
        self.single = np.array([f for f, size in enumerate(self.sizes) if size == 2], np.int64)
        self.wide = [f for f, size in enumerate(self.sizes) if size > 2]
        self.start = np.cumsum([0, *(size - 1 for size in self.sizes)])

    def left(self, bins: np.ndarray, node: np.ndarray, nodes: int, numbers: np.ndarray) -> np.ndarray:
        """nodes x cuts x numbers: their sums on the left of each cut. Rows of node number `nodes` are left out."""
        found = np.zeros((nodes, len(self.feature), len(numbers)))
        if len(self.single):
            width, sums = nodes + 1, np.zeros((len(self.single), (nodes + 1) * len(numbers)))
            for s in range(0, len(node), BLOCK_ROWS):
                e = min(s + BLOCK_ROWS, len(node))
                parted, at = np.zeros((e - s, sums.shape[1])), np.arange(e - s)
                for i, x in enumerate(numbers):
                    parted[at, i * width + node[s:e]] = x[s:e]
                sums += (bins[s:e].take(self.single, 1) ^ 1).astype(float).T @ parted  # 1 on the left of the only cut
            found[:, self.start[self.single]] = sums.reshape(-1, len(numbers), width)[..., :nodes].transpose(2, 0, 1)
        for f in self.wide:
            at, size = node * self.sizes[f] + bins[:, f], self.sizes[f]
            for i, x in enumerate(numbers):
                cells = np.bincount(at, x, (nodes + 1) * size).reshape(nodes + 1, size)[:nodes]
                found[:, self.start[f]:self.start[f + 1], i] = np.cumsum(cells, 1)[:, :-1]
        return found


@dataclass
class Rules:
    """What all tasks know of a fit."""

    cuts: Cuts
    trees: int
    rate: float
    depth: int
    leaf: int
    share: float  # of the rows, drawn for each tree
    seed: int

    def taken(self, rows: np.ndarray, tree: int) -> np.ndarray:
        """1 for the rows drawn for a tree, 0 for the others, by row number."""
        if self.share >= 1.0:
            return np.ones(len(rows))
        key = scrambled(np.array([(self.seed * 0x9E3779B97F4A7C15 + tree + 1) % 2**64], np.uint64))
        return ((scrambled(scrambled(rows.astype(np.uint64)) ^ key) >> np.uint64(11)) * 2.0**-53 < self.share).astype(float)

    def weight(self, tree: int) -> float:
        return self.rate if tree else 1.0


class Tree:
    """A tree as it grows: level by level, parents first, the two children of a node side by side."""

    def __init__(self):
        self.feature, self.cut, self.gain, self.child = np.array([-1]), np.array([0]), np.array([-1.0]), np.array([-1])
        self.stats = np.zeros((1, 3))  # rows, sum and sum of squares of what the tree learns
        self.open = np.array([0])

    @property
    def value(self) -> np.ndarray:
        return self.stats[:, 1] / np.maximum(self.stats[:, 0], 1.0)

    @property
    def impurity(self) -> np.ndarray:
        n = np.maximum(self.stats[:, 0], 1.0)
        return np.maximum(self.stats[:, 2] / n - (self.stats[:, 1] / n) ** 2, 0.0)

    def places(self) -> np.ndarray:
        """The place of each node among the open ones; their number for the others."""
        place = np.full(len(self.child), len(self.open))
        place[self.open] = np.arange(len(self.open))
        return place

    def route(self) -> tuple[np.ndarray, ...]:
        """What a step looks up: a row in a leaf stays there, as no bin is above 255."""
        ended = self.child < 0
        return (np.where(ended, np.arange(len(ended)), self.child), np.where(ended, 0, self.feature), np.where(ended, 255, self.cut).astype(np.uint8))

    def reached(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node each row is in, so many levels below the root."""
        route, node = self.route(), np.zeros(len(bins), np.int64)
        for _ in range(levels if len(self.child) > 1 else 0):
            node = stepped(node, bins, route)
        return node

    def split(self, whole: np.ndarray, left: np.ndarray, rules: Rules) -> None:
        """Divides the open nodes by their numbers and those on the left of every cut; the first of equal cuts."""
        nodes, cuts = self.open, rules.cuts
        self.stats[nodes] = whole
        right = whole[:, None] - left
        with np.errstate(invalid="ignore", divide="ignore"):
            n, mean = whole[:, 0], whole[:, 1] / whole[:, 0]
            gain = (left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0]) / n[:, None] - (mean * mean)[:, None]
        gain = np.where((left[..., 0] >= rules.leaf) & (right[..., 0] >= rules.leaf), np.nan_to_num(gain, nan=-1.0), -1.0)
        if not gain.shape[1]:
            self.open = np.zeros(0, np.int64)
            return
        best, at = gain.argmax(1), np.arange(len(nodes))
        gain = gain[at, best]
        noise = EPSILON * whole[:, 2] / np.maximum(n, 1.0)  # a gain that should be 0
        divided = np.flatnonzero((gain > 8 * noise) & (self.impurity[nodes] >= EPSILON))
        parents, first = nodes[divided], len(self.child)
        self.feature[parents], self.cut[parents] = cuts.feature[best[divided]], cuts.cut[best[divided]]
        self.gain[parents], self.child[parents] = gain[divided], first + 2 * np.arange(len(divided))
        more = 2 * len(divided)
        self.feature, self.cut = np.append(self.feature, np.full(more, -1)), np.append(self.cut, np.zeros(more, np.int64))
        self.gain, self.child = np.append(self.gain, np.full(more, -1.0)), np.append(self.child, np.full(more, -1))
        sides = np.stack([left[divided, best[divided]], right[divided, best[divided]]], 1).reshape(-1, 3)
        self.stats = np.concatenate([self.stats, sides])
        self.open = np.arange(first, first + more)

    def rows(self, number: int, thresholds: list[np.ndarray]) -> pd.DataFrame:
        """As rows of NODES."""
        inner = self.child >= 0
        threshold = [float(thresholds[f][c]) if i else 0.0 for f, c, i in zip(self.feature, self.cut, inner)]
        return pd.DataFrame({
            "tree": number, "id": np.arange(len(inner)), "left": self.child, "right": np.where(inner, self.child + 1, -1),
            "feature": np.where(inner, self.feature, -1), "threshold": threshold, "gain": self.gain, "impurity": self.impurity,
            "prediction": self.value, "rows": self.stats[:, 0], "total": self.stats[:, 1], "squares": self.stats[:, 2]})


def stepped(node: np.ndarray, bins: np.ndarray, route: tuple[np.ndarray, ...]) -> np.ndarray:
    """Rows that stand in a divided node go on to its child."""
    child, feature, cut = (x.take(node) for x in route)
    return child + (bins.ravel().take(feature + np.arange(0, bins.size, max(1, bins.shape[1]))) > cut)


def wanted(sign: np.ndarray, margin: np.ndarray, tree: int) -> np.ndarray:
    """What a tree learns: the labels as -1 and 1 at first, then what Spark's log loss falls by."""
    if not tree:
        return sign
    with np.errstate(over="ignore"):
        return 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))


def summed(tree: Tree, node: np.ndarray, bins: np.ndarray, numbers: np.ndarray, cuts: Cuts) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the open nodes, and those on the left of every cut."""
    place, nodes = tree.places()[node], len(tree.open)
    whole = np.stack([np.bincount(place, x, nodes + 1)[:nodes] for x in numbers], -1)
    return whole, cuts.left(bins, place, nodes, numbers)


def numbers_of(target: np.ndarray, taken: np.ndarray) -> np.ndarray:
    return np.stack([taken, target * taken, target * target * taken])


def grown(blocks: list[tuple[np.ndarray, ...]], rules: Rules) -> Iterator[Tree]:
    """All trees, of rows that are held at once: blocks as `blocks_of` has them, which are left empty."""
    blocks.sort(key=lambda b: b[0][0])  # sums to the same last digits, however the rows came
    row, label, bins = (np.concatenate([b[i] for b in blocks]) for i in (0, 1, 3))
    blocks.clear()
    sign, margin = 2.0 * label - 1.0, np.zeros(len(row))
    for number in range(rules.trees):
        numbers, tree, node = numbers_of(wanted(sign, margin, number), rules.taken(row, number)), Tree(), np.zeros(len(row), np.int64)
        for level in range(rules.depth):
            tree.split(*summed(tree, node, bins, numbers, rules.cuts), rules)
            node = stepped(node, bins, tree.route())
            if not len(tree.open):
                break
        if not rules.depth:
            tree.stats[0] = numbers.sum(1)
        margin += rules.weight(number) * tree.value[node]
        yield tree


def blocks_of(batches) -> Iterator[tuple[np.ndarray, ...]]:
    """The stored blocks: row numbers, labels, margins and bins (rows x features)."""
    for batch in batches:
        for row, label, margin, bins in zip(*(batch.column(c) for c in ("row", "label", "margin", "bins"))):
            row = np.frombuffer(row.as_buffer(), np.int64)
            yield (row, np.frombuffer(label.as_buffer()), np.frombuffer(margin.as_buffer()),
                   np.frombuffer(bins.as_buffer(), np.uint8).reshape(len(row), -1))


def block(row: np.ndarray, label: np.ndarray, margin: np.ndarray, bins: np.ndarray) -> pa.RecordBatch:
    cells = (np.ascontiguousarray(x).tobytes() for x in (row.astype(np.int64), label.astype(float), margin.astype(float), bins))
    return pa.record_batch([pa.array([c], pa.binary()) for c in cells], ["row", "label", "margin", "bins"])


# ---- rows in bins -------------------------------------------------------------------------------
@dataclass
class Binned:
    """Training rows in bins, for all fits on them."""

    table: DataFrame  # blocks
    rows: int
    cuts: Cuts
    one: DataFrame  # one row as it came
    described: tuple | None = None

    def form(self, like: GBTClassifier) -> tuple[dict, dict, StructType]:
        """How Spark describes a model of these columns and a tree of it, to be filled in; a model of one root on one row."""
        with _ONE:
            if self.described is None:
                spark, small = self.one.sparkSession, new_path(self.one.sparkSession, "boosted-form")
                root = like.copy({like.maxDepth: 0, like.maxIter: 1, like.subsamplingRate: 1.0, like.minInstancesPerNode: 1})
                root.fit(self.one).write().save(small)
                trees = spark.read.parquet(f"{small}/treesMetadata")
                self.described = spark.read.text(f"{small}/metadata").first()[0], trees.first()[1], trees.schema
        main, tree, columns = self.described
        return json.loads(main), json.loads(tree), columns


_BINNED: WeakKeyDictionary[DataFrame, tuple[threading.Lock, list[Binned]]] = WeakKeyDictionary()
_ONE = threading.Lock()


def binned(train: DataFrame, column: str) -> Binned | None:
    """The rows of a table in bins, once for as long as the table is held; None where Spark would group categories."""
    with _ONE:
        lock, made = _BINNED.setdefault(train, (threading.Lock(), []))
    with lock:
        if not made:
            made.append(_sorted_in(train, column))
        return made[0]


def _sorted_in(train: DataFrame, column: str) -> Binned | None:
    attributes = train.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    if any(len(a.get("vals", [])) > 2 for a in attributes.get("nominal", [])):
        return None
    binary = {a["idx"] for kind in ("binary", "nominal") for a in attributes.get(kind, [])}
    table = train.select(F.col("label").cast("double").alias("label"), vector_to_array(column).alias("x"))
    first = table.select(F.size("x").alias("n")).first()
    if first is None:
        return None
    features = first["n"]
    cuts = Cuts(feature_thresholds(table, binary, features))
    thresholds = cuts.thresholds

    def sort_in(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), features)
            row, label = (batch.column(c).to_numpy() for c in ("row", "label"))
            bins = np.stack([np.searchsorted(t, x[:, f], "left") for f, t in enumerate(thresholds)], 1).astype(np.uint8)
            for s in range(0, len(batch), BLOCK_ROWS):
                part = slice(s, s + BLOCK_ROWS)
                yield block(row[part], label[part], np.zeros(len(row[part])), bins[part])

    numbered = table.select(F.monotonically_increasing_id().alias("row"), "label", "x")
    blocks = stored(numbered.mapInArrow(sort_in, BLOCK), "boosted-rows")
    rows = blocks.agg(F.sum(F.octet_length("row")).alias("n")).first()["n"] // 8
    form = train.select("label", column)
    return Binned(blocks, rows, cuts, train.sparkSession.createDataFrame(form.limit(1).collect(), form.schema))


# ---- fitting ------------------------------------------------------------------------------------
def level_sums(table: DataFrame, tree: Tree, number: int, before: list[tuple[float, Tree]], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the open nodes and on the left of every cut, by one scan."""
    nodes, cuts = len(tree.open), len(rules.cuts.feature)

    def count(batches):
        whole, left = np.zeros((nodes, 3)), np.zeros((nodes, cuts, 3))
        for row, label, margin, bins in blocks_of(batches):
            sign, margin = 2.0 * label - 1.0, with_trees(margin, bins, before, rules.depth)
            numbers = numbers_of(wanted(sign, margin, number), rules.taken(row, number))
            more = summed(tree, tree.reached(bins, rules.depth), bins, numbers, rules.cuts)
            whole += more[0]
            left += more[1]
        yield pa.record_batch([pa.array([whole.tobytes()], pa.binary()), pa.array([left.tobytes()], pa.binary())], ["whole", "left"])

    whole, left = np.zeros((nodes, 3)), np.zeros((nodes, cuts, 3))
    for found in sorted(map(tuple, table.mapInArrow(count, "whole binary, left binary").collect())):  # kilobytes a task
        whole += np.frombuffer(found[0]).reshape(whole.shape)
        left += np.frombuffer(found[1]).reshape(left.shape)
    return whole, left


def with_trees(margin: np.ndarray, bins: np.ndarray, trees: list[tuple[float, Tree]], depth: int) -> np.ndarray:
    for weight, tree in trees:
        margin = margin + weight * tree.value[tree.reached(bins, depth)]
    return margin


def grown_by_levels(data: Binned, rules: Rules) -> list[Tree]:
    """All trees, a scan a level."""
    spark, table, trees, since = data.table.sparkSession, data.table, [], []
    paths = [new_path(spark, "margins"), new_path(spark, "margins")]  # one is read while the other is written

    def rewritten(df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(BLOCK).parquet(path)

    for number in range(rules.trees):
        tree = Tree()
        for _ in range(max(1, rules.depth)):
            whole, left = level_sums(table, tree, number, since, rules)
            if not rules.depth:
                tree.stats[0] = whole[0]
                break
            tree.split(whole, left, rules)
            if not len(tree.open):
                break
        trees.append(tree)
        since.append((rules.weight(number), tree))
        if len(since) == MARGINS_EVERY and number + 1 < rules.trees:
            def moved(batches, done=tuple(since)):
                for row, label, margin, bins in blocks_of(batches):
                    yield block(row, label, with_trees(margin, bins, done, rules.depth), bins)

            table, since = rewritten(table.mapInArrow(moved, BLOCK), paths[len(trees) // MARGINS_EVERY % 2]), []
    for path in paths if rules.trees > MARGINS_EVERY else ():  # the margins are not needed any more
        spark.createDataFrame([], BLOCK).write.mode("overwrite").parquet(path)
    return trees


@dataclass
class BinnedBoosting:
    """Fits like the `GBTClassifier` it is made from."""

    like: GBTClassifier

    def fit(self, train: DataFrame) -> GBTClassificationModel:
        like, spark = self.like, train.sparkSession
        data = binned(train, like.getFeaturesCol())
        if data is None or like.getMaxDepth() > DEEPEST:
            return like.fit(train)
        rules = Rules(data.cuts, like.getMaxIter(), like.getStepSize(), like.getMaxDepth(), like.getMinInstancesPerNode(),
                      like.getSubsamplingRate(), like.getSeed())
        thresholds = data.cuts.thresholds
        if data.rows <= LOCAL_ROWS:
            def grow(batches):
                blocks = [b for b in blocks_of(batches) if len(b[0])]
                for number, tree in enumerate(grown(blocks, rules) if blocks else ()):
                    yield pa.RecordBatch.from_pandas(tree.rows(number, thresholds).astype(
                        {"tree": "int32", "id": "int32", "left": "int32", "right": "int32", "feature": "int32"}), preserve_index=False)

            nodes = data.table.coalesce(1).mapInArrow(grow, NODES)
        else:
            trees = grown_by_levels(data, rules)
            nodes = spark.createDataFrame(pd.concat([tree.rows(n, thresholds) for n, tree in enumerate(trees)]), NODES)
        path = new_path(spark, "boosted")
        self.write(data, path, nodes, rules)
        return GBTClassificationModel.load(path)

    def write(self, data: Binned, path: str, nodes: DataFrame, rules: Rules) -> None:
        """The model's files: as those of a model of one root, with this one's settings and the nodes of all its trees."""
        like, spark = self.like, nodes.sparkSession
        settings = {p.name: v for p, v in like.extractParamMap().items() if like.isSet(p)}
        main, tree, columns = data.form(like)
        main["paramMap"] |= settings
        main["uid"], main["numTrees"] = like.uid, rules.trees
        tree["paramMap"] |= {k: v for k, v in settings.items() if k in tree["paramMap"]}
        spark.createDataFrame([(json.dumps(main),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        trees = [(n, json.dumps(tree | {"uid": f"{like.uid}_{n}"}), rules.weight(n)) for n in range(rules.trees)]
        spark.createDataFrame(trees, columns).coalesce(1).write.parquet(f"{path}/treesMetadata")
        split = F.struct(F.col("feature").alias("featureIndex"),
                         F.when(F.col("left") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                         F.lit(-1).alias("numCategories"))
        node = F.struct("id", "prediction", "impurity", F.array("rows", "total", "squares").alias("impurityStats"),
                        F.col("rows").cast("long").alias("rawCount"), "gain", F.col("left").alias("leftChild"),
                        F.col("right").alias("rightChild"), split.alias("split"))
        nodes.select(F.col("tree").alias("treeID"), node.alias("nodeData")).write.parquet(f"{path}/data")

