"""Random forests without a depth limit.

Spark's forest keeps statistics of every node of a level, and reads all rows again for each 512 MB of them: rows times nodes.
Here only nodes of many rows are split like that, level by level, each level one scan. The rows of a smaller node are brought
together, and one task grows the whole tree below it. Time grows with rows times depth. The result is Spark's own model in
files of its format. It is not loaded: its nodes grow with the rows, and the driver's memory does not. Rows meet its trees in
groups of a checked size.
"""

from __future__ import annotations

import json
import math
import pickle
import sys
import threading
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Transformer
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.session import new_path, stored

LOCAL_ROWS = 100_000  # rows, repeats drawn included, of a node whose tree below is grown by one task
BINS = 32
GROUP_BYTES = 8 << 20  # packed trees that the driver holds at once
TASK_BYTES = 64 << 20  # and a task
_ONE = threading.Lock()
EPSILON = 2.0**-52
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(17)])
NODES = ("node long, place long, left long, right long, feature int, threshold double, gain double, impurity double, "
         "prediction double, negative double, positive double, raw long")

# tasks get this module's functions with the job, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def scrambled(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def drawn(rows: np.ndarray, key: int) -> np.ndarray:
    """How often each row is drawn into a tree (Poisson with mean 1), by row number and the tree's key."""
    chance = (scrambled(scrambled(rows.astype(np.uint64)) ^ np.uint64(key)) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_POISSON, chance, "right")


def child_keys(keys: np.ndarray, side: int) -> np.ndarray:
    return scrambled(keys * np.uint64(2) + np.uint64(side + 1))


def asked_features(keys: np.ndarray, features: int, take: int) -> np.ndarray:
    """Which features each node may split by: `take` of them, drawn by its key."""
    if take >= features:
        return np.ones((len(keys), features), bool)
    chance = scrambled(keys[:, None] + np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return chance <= np.partition(chance, take - 1, axis=1)[:, take - 1:take]


def gini(stats: np.ndarray) -> np.ndarray:
    """Impurity by the weights of both classes, in the last axis."""
    with np.errstate(invalid="ignore", divide="ignore"):
        share = stats[..., :2] / (stats[..., 0] + stats[..., 1])[..., None]
    return np.nan_to_num(1.0 - share[..., 0] * share[..., 0] - share[..., 1] * share[..., 1], nan=0.0)


def counted(bins: np.ndarray, node: np.ndarray, nodes: int, size: int, numbers: np.ndarray) -> np.ndarray:
    """nodes x bins of a feature x (weight of the negatives, of the positives, rows)."""
    at = node * size + bins
    return np.stack([np.bincount(at, x, nodes * size) for x in numbers], -1).reshape(nodes, size, 3)


def counted_in(some: np.ndarray, bins: np.ndarray, node: np.ndarray, nodes: int, size: int, numbers: np.ndarray) -> np.ndarray:
    """The cells of some nodes only."""
    if len(some) == nodes:
        return counted(bins, node, nodes, size, numbers)
    place = np.full(nodes, -1)
    place[some] = np.arange(len(some))
    rows = np.flatnonzero(place[node] >= 0)
    return counted(bins[rows], place[node[rows]], len(some), size, numbers[:, rows])


def best_cut(cells: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one feature's cells (nodes x bins x 3): for each node the best gain, its cut (the last bin on the left; the first
    of equal ones) and the numbers on both sides. These are sums and no differences, so none falls below 0."""
    left, right = np.cumsum(cells, 1), np.cumsum(cells[:, ::-1], 1)[:, -2::-1]
    whole, left = left[:, -1:], left[:, :-1]
    weight = lambda x: x[..., 0] + x[..., 1]
    with np.errstate(invalid="ignore", divide="ignore"):
        # in this order, as Spark: a gain that should be 0 is rounded the same way
        gain = gini(whole) - weight(left) / weight(whole) * gini(left) - weight(right) / weight(whole) * gini(right)
    gain = np.where((left[..., 2] >= leaf) & (right[..., 2] >= leaf), np.nan_to_num(gain, nan=0.0), -1.0)
    cut = gain.argmax(1)
    at = np.arange(len(cells))
    return gain[at, cut], cut, np.stack([left[at, cut], right[at, cut]], 1)


@dataclass
class Rules:
    """What all tasks know: thresholds of each feature, and when to stop."""

    thresholds: list[np.ndarray]
    depth: int
    leaf: int
    take: int
    sizes: list[int] = field(init=False)

    def __post_init__(self):
        self.sizes = [len(t) + 1 for t in self.thresholds]


def best_splits(cells_of, keys: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gain (0 or less: none), feature, cut and the numbers on both sides, for each node; the first of equal features."""
    n = len(keys)
    asked = asked_features(keys, len(rules.sizes), rules.take)
    gain, feature, cut, sides = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64), np.zeros((n, 2, 3))
    for f, size in enumerate(rules.sizes):
        nodes = np.flatnonzero(asked[:, f])
        if size < 2 or not len(nodes):
            continue
        g, c, numbers = best_cut(cells_of(f, nodes), rules.leaf)
        better = g > gain[nodes]
        at = nodes[better]
        gain[at], feature[at], cut[at], sides[at] = g[better], f, c[better], numbers[better]
    return gain, feature, cut, sides


def grown(bins: np.ndarray, numbers: np.ndarray, key: int, level: int, rules: Rules) -> pd.DataFrame:
    """The tree below a node as rows of NODES, pruned, parents first. `bins` are rows x features, `numbers` 3 x rows."""
    stats, keys = [numbers.sum(1)[None]], np.array([key], np.uint64)
    features, cuts, gains, firsts = [], [], [], []
    bins, node, placed = np.ascontiguousarray(bins.T), np.zeros(len(bins), np.int64), 0
    while len(keys):
        n, here = len(keys), stats[-1]
        placed += n
        live = (gini(here) >= EPSILON) & (level < rules.depth)
        # rows of finished nodes leave, the others are numbered anew
        number = np.cumsum(live) - 1
        stay = live[node]
        bins, numbers, node = bins[:, stay], numbers[:, stay], number[node[stay]]
        gain, feature, cut, sides = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64), np.zeros((n, 2, 3))
        if live.any():
            gain[live], feature[live], cut[live], sides[live] = best_splits(
                lambda f, nodes: counted_in(nodes, bins[f], node, int(live.sum()), rules.sizes[f], numbers), keys[live], rules)
        split = np.flatnonzero(feature >= 0)
        first = np.full(n, -1)
        first[split] = placed + 2 * np.arange(len(split))
        features.append(feature), cuts.append(cut), gains.append(np.where(feature >= 0, gain, -1.0)), firsts.append(first)
        # two children side by side
        divided = feature[live] >= 0
        stay = divided[node]
        bins, numbers, node = bins[:, stay], numbers[:, stay], (np.cumsum(divided) - 1)[node[stay]]
        right = bins[feature[split][node], np.arange(len(node))] > cut[split][node]
        node = 2 * node + right
        keys = np.stack([child_keys(keys[split], 0), child_keys(keys[split], 1)], 1).ravel()
        stats.append(sides[split].reshape(-1, 3))
        level += 1
    stats, feature, cut, gain, first = (np.concatenate(x) for x in (stats, features, cuts, gains, firsts))
    prediction = (stats[:, 1] > stats[:, 0]).astype(float)
    # two leaves that predict the same become one, as in Spark's trees; then the places of what is left
    for place in np.flatnonzero(first >= 0)[::-1].tolist():
        one = first[place]
        if first[one] < 0 and first[one + 1] < 0 and prediction[one] == prediction[one + 1]:
            first[place] = -1
    reached = np.zeros(len(first), bool)
    reached[0] = True
    for place in np.flatnonzero(first >= 0).tolist():
        if reached[place]:
            reached[first[place]:first[place] + 2] = True
    at = np.flatnonzero(reached)
    new = np.cumsum(reached) - 1
    inner = first[at] >= 0
    threshold = np.zeros(len(at))
    for f in np.unique(feature[at[inner]]):
        mine = inner & (feature[at] == f)
        threshold[mine] = rules.thresholds[f][cut[at[mine]]]
    return pd.DataFrame({
        "node": 0, "place": np.arange(len(at)), "left": np.where(inner, new[first[at]], -1),
        "right": np.where(inner, new[first[at] + inner], -1), "feature": np.where(inner, feature[at], -1),
        "threshold": threshold, "gain": np.where(inner, gain[at], -1.0), "impurity": gini(stats[at]),
        "prediction": prediction[at], "negative": stats[at, 0], "positive": stats[at, 1], "raw": np.rint(stats[at, 2]).astype(np.int64)})


# ---- the upper nodes ----------------------------------------------------------------------------
class Upper:
    """The upper nodes of all trees, numbered together, parents first; the first ones are the roots."""

    def __init__(self, trees: int, seed: int, draws: bool):
        own = scrambled(np.arange(trees, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64))
        self.trees, self.bags = trees, own.tolist() if draws else [None] * trees
        self.key = scrambled(own + np.uint64(1)).tolist()
        self.tree, self.level, self.stats = list(range(trees)), [0] * trees, [np.zeros(3)] * trees
        self.feature, self.cut, self.gain = [-1] * trees, [0] * trees, [-1.0] * trees
        self.child = [-1] * trees  # the left one; the right one follows it
        self.state = ["open"] * trees  # to be split by all tasks; or to be grown by one: "local"; or "inner", "leaf"

    def split(self, node: int, feature: int, cut: int, gain: float, sides: np.ndarray, rules: Rules) -> None:
        self.feature[node], self.cut[node], self.gain[node], self.child[node], self.state[node] = feature, cut, gain, len(self.tree), "inner"
        for side, stats in enumerate(sides):
            self.key.append(int(child_keys(np.array([self.key[node]], np.uint64), side)[0]))
            self.tree.append(self.tree[node]), self.level.append(self.level[node] + 1), self.stats.append(stats)
            self.feature.append(-1), self.cut.append(0), self.gain.append(-1.0), self.child.append(-1)
            done = self.level[-1] >= rules.depth or gini(stats) < EPSILON
            self.state.append("leaf" if done else "open" if stats[2] > LOCAL_ROWS else "local")

    def some(self, state: str) -> list[int]:
        return [node for node, s in enumerate(self.state) if s == state]

    def routes(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x) for x in (self.feature, self.cut, self.child))


def placed(bins: np.ndarray, tree: int, routes: tuple[np.ndarray, ...]) -> np.ndarray:
    """The upper node each row ends in."""
    feature, cut, child = routes
    node, going = np.full(len(bins), tree), np.arange(len(bins))
    while len(going := going[child[node[going]] >= 0]):
        at = node[going]
        node[going] = child[at] + (bins[going, feature[at]] > cut[at])
    return node


def drawn_rows(batches, bags: list[int | None], routes, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each batch and tree: row numbers, bins, numbers and `wanted` place of the drawn rows that end in a wanted node."""
    for batch in batches:
        if not len(batch):
            continue
        rows, label, weight = (batch.column(c).to_numpy() for c in ("row", "label", "weight"))
        bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(batch), -1)
        for tree, bag in enumerate(bags):
            times = np.ones(len(rows), np.int64) if bag is None else drawn(rows, bag)
            node = placed(bins, tree, routes)
            take = np.flatnonzero((times > 0) & (wanted[node] >= 0))
            if len(take):
                w = weight[take] * times[take]
                yield rows[take], bins[take], np.stack([w * (label[take] == 0), w * (label[take] != 0), times[take]]), wanted[node[take]]


def split_level(table: DataFrame, upper: Upper, rules: Rules) -> None:
    """Splits all open nodes by one scan."""
    nodes, routes, bags = upper.some("open"), upper.routes(), upper.bags
    wanted = np.full(len(upper.tree), -1)
    wanted[nodes] = np.arange(len(nodes))
    keys, edges = {node: upper.key[node] for node in nodes}, np.cumsum([0, *rules.sizes])

    def count(batches):
        cells = np.zeros((len(nodes), edges[-1], 3))
        for _, bins, numbers, place in drawn_rows(batches, bags, routes, wanted):
            for f, size in enumerate(rules.sizes):
                cells[:, edges[f]:edges[f + 1]] += counted(bins[:, f], place, len(nodes), size, numbers)
        for k in np.flatnonzero(cells[:, :rules.sizes[0], 2].any(1)):
            yield pa.record_batch([pa.array([nodes[k]], pa.int64()), pa.array([cells[k].tobytes()], pa.binary())], ["node", "cells"])

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        node = int(part["node"].iloc[0])
        cells = sum(np.frombuffer(b) for b in sorted(part["cells"])).reshape(1, -1, 3)
        gain, feature, cut, sides = best_splits(lambda f, _: cells[:, edges[f]:edges[f + 1]], np.array([keys[node]], np.uint64), rules)
        whole = cells[0, :rules.sizes[0]].sum(0)
        return pd.DataFrame({"node": [node], "feature": feature, "cut": cut, "gain": gain, "sides": [sides[0].ravel().tolist()], "whole": [whole.tolist()]})

    found = table.mapInArrow(count, "node long, cells binary").groupBy("node").applyInPandas(
        decide, "node long, feature int, cut int, gain double, sides array<double>, whole array<double>").collect()  # a short row a node
    for r in sorted(found, key=lambda r: r["node"]):
        node = r["node"]
        upper.stats[node] = np.array(r["whole"])
        if r["feature"] < 0:
            upper.state[node] = "leaf"
        else:
            upper.split(node, r["feature"], r["cut"], r["gain"], np.array(r["sides"]).reshape(2, 3), rules)


def grow_below(table: DataFrame, upper: Upper, rules: Rules) -> DataFrame:
    """The trees below all local nodes, each grown by one task; stored."""
    nodes, routes, bags = upper.some("local"), upper.routes(), upper.bags
    wanted = np.full(len(upper.tree), -1)
    wanted[nodes] = nodes
    told = {node: (upper.key[node], upper.level[node]) for node in nodes}

    def deal(batches):
        for number, bins, numbers, node in drawn_rows(batches, bags, routes, wanted):
            by = np.argsort(node, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(node[by]) != 0, [True])))
            rows = [by[s:e] for s, e in zip(cuts[:-1], cuts[1:])]
            yield pa.record_batch([
                pa.array([int(node[r[0]]) for r in rows], pa.int64()), pa.array([number[r].tobytes() for r in rows], pa.binary()),
                pa.array([bins[r].tobytes() for r in rows], pa.binary()), pa.array([numbers[:, r].T.tobytes() for r in rows], pa.binary())],
                ["node", "row", "bins", "numbers"])

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        node = int(part["node"].iloc[0])
        bins = np.frombuffer(b"".join(part["bins"]), np.uint8).reshape(-1, len(rules.sizes))
        numbers = np.frombuffer(b"".join(part["numbers"])).reshape(-1, 3)
        by = np.argsort(np.frombuffer(b"".join(part["row"]), np.int64))  # sums to the same last digits, however the rows came
        return grown(bins[by], np.ascontiguousarray(numbers[by].T), *told[node], rules).assign(node=node)

    dealt = table.mapInArrow(deal, "node long, row binary, bins binary, numbers binary").repartition(max(1, len(nodes)), "node")
    return stored(dealt.groupBy("node").applyInPandas(grow, NODES), "subtrees")


# ---- the model ----------------------------------------------------------------------------------
def feature_thresholds(table: DataFrame, binary: set[int], features: int) -> list[np.ndarray]:
    """Where each feature may be cut: all values if few, quantiles if many. Rows up to a threshold go left."""
    found: list[np.ndarray] = [np.array([0.5])] * features
    rest = [f for f in range(features) if f not in binary]
    if not rest:
        return found
    columns = table.select(*[F.col("x")[f].alias(f"x{f}") for f in rest])
    few = columns.agg(*[F.approx_count_distinct(c).alias(c) for c in columns.columns]).first()
    short = [c for c in columns.columns if few[c] <= BINS]
    values = columns.agg(*[F.collect_set(c).alias(c) for c in short]).first() if short else {}
    probabilities = [k / BINS for k in range(1, BINS)]
    wide = [c for c in columns.columns if few[c] > BINS]
    quantiles = dict(zip(wide, columns.approxQuantile(wide, probabilities, 0.001))) if wide else {}
    for f in rest:
        kept = np.unique(np.array(values[f"x{f}"] if f"x{f}" in short else quantiles[f"x{f}"], float))
        found[f] = (kept[1:] + kept[:-1]) / 2 if f"x{f}" in short else kept
    return found


def packed(nodes: pd.DataFrame) -> bytes:
    """A tree as arrays over its nodes in the order of their numbers: children (-1 at a leaf), feature, threshold and share of the positives."""
    nodes = nodes.sort_values("id")
    return pickle.dumps((nodes["left"].to_numpy(np.int32), nodes["right"].to_numpy(np.int32), nodes["feature"].to_numpy(np.int16),
                         nodes["threshold"].to_numpy(float), nodes["share"].to_numpy(float)))


def votes(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """The sum over trees of the share of positives in the leaf each row ends in."""
    total = np.zeros(len(x))
    for left, right, feature, threshold, share in trees:
        node, going = np.zeros(len(x), np.int32), np.arange(len(x))
        while len(going := going[left[node[going]] >= 0]):
            at = node[going]
            node[going] = np.where(x[going, feature[at]] <= threshold[at], left[at], right[at])
        total += share[node]
    return total


class StoredForest(Transformer, MLReadable, MLWritable):
    """A forest in the files of Spark's model, met by rows where it lies; whatever else is asked of it, the loaded model answers."""

    def __init__(self, path: str):
        super().__init__()
        self.path, self._told, self._loaded, self._trees = path, None, None, None

    def __getattr__(self, name: str):
        if name.startswith("_") or name == "path":
            raise AttributeError(name)
        if self._loaded is None:
            self._loaded = RandomForestClassificationModel.load(self.path)
        return getattr(self._loaded, name)

    @property
    def told(self) -> dict:
        """How the model describes itself."""
        if self._told is None:
            self._told = json.loads(SparkSession.active().read.text(f"{self.path}/metadata").first()["value"])
        return self._told

    def setting(self, name: str):
        return {**self.told["defaultParamMap"], **self.told["paramMap"]}[name]

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - as Spark's model has it
        return self.told["numTrees"]

    @property
    def numFeatures(self) -> int:  # noqa: N802
        return self.told["numFeatures"]

    def nodes(self) -> DataFrame:
        return SparkSession.active().read.parquet(f"{self.path}/data").select("treeID", "nodeData.*")

    @property
    def totalNumNodes(self) -> int:  # noqa: N802
        return self.nodes().count()

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """As Spark: gains times weights of the rows, of each tree with sum 1."""
        weight = F.aggregate("impurityStats", F.lit(0.0), lambda total, v: total + v)
        found = self.nodes().where("leftChild >= 0").groupBy("treeID", F.col("split.featureIndex").alias("feature")).agg(
            F.sum(F.col("gain") * weight).alias("gain")).collect()  # a number a tree and feature
        sums = np.zeros((self.getNumTrees, self.numFeatures))
        for r in found:
            sums[r["treeID"], r["feature"]] = r["gain"]
        shares = (sums / np.maximum(sums.sum(1), 1e-300)[:, None]).sum(0)
        return DenseVector(shares / max(shares.sum(), 1e-300))

    def packed_trees(self) -> DataFrame:
        """(tree, size, packed), a row a tree; stored."""
        if self._trees is None:
            def pack(part: pd.DataFrame) -> pd.DataFrame:
                tree = packed(part)
                return pd.DataFrame({"tree": part["treeID"].iloc[:1].to_numpy(), "size": len(tree), "packed": [tree]})

            stats = F.col("impurityStats")
            flat = self.nodes().select(
                "treeID", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
                F.coalesce(F.get("split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("threshold"),
                F.try_divide(stats[1], stats[0] + stats[1]).alias("share")).fillna(0.0, ["share"])
            self._trees = stored(flat.groupBy("treeID").applyInPandas(pack, "tree int, size long, packed binary"), "forest-trees")
        return self._trees

    def groups(self, limit: int) -> list[list[tuple[int, int]]]:
        """(tree, bytes), cut into groups of at most so many bytes; a larger tree is a group of its own."""
        found, room = [], 0
        for r in sorted(self.packed_trees().select("tree", "size").collect()):  # a short row a tree
            if r["size"] > room:
                found.append([])
                room = limit
            found[-1].append((r["tree"], r["size"]))
            room -= r["size"]
        return found

    def _shared(self, spark: SparkSession, group: list[int]):
        with _ONE:  # the driver holds one group, whatever is scored at the same time
            rows = self.packed_trees().where(F.col("tree").isin(group)).orderBy("tree").select("packed").collect()
            return spark.sparkContext.broadcast([bytes(r["packed"]) for r in rows])

    def _transform(self, df: DataFrame) -> DataFrame:
        x, count, features = vector_to_array(self.setting("featuresCol")), float(self.getNumTrees), self.numFeatures
        voted, held, shared = df.withColumn("_votes", F.lit(0.0)), 0, []
        for group in self.groups(GROUP_BYTES):
            size = sum(size for _, size in group)
            if shared and held + size > TASK_BYTES and not df.isStreaming:
                # so that a task holds few groups
                voted = stored(voted.withColumn("_votes", F.col("_votes") + _voting(shared, features)(x)), "voted")
                held, shared = 0, []
            held += size
            shared.append(self._shared(df.sparkSession, [tree for tree, _ in group]))
        voted = voted.withColumn("_votes", F.col("_votes") + _voting(shared, features)(x))
        raw = F.array(F.lit(count) - F.col("_votes"), F.col("_votes"))
        return voted.withColumns({
            self.setting("rawPredictionCol"): array_to_vector(raw),
            self.setting("probabilityCol"): array_to_vector(F.transform(raw, lambda v: v / count)),
            self.setting("predictionCol"): F.when(F.col("_votes") * 2 > count, 1.0).otherwise(0.0)}).drop("_votes")

    def write(self) -> MLWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return ForestReader()


def _voting(shared: list, features: int):
    """Reads the broadcast groups of trees once a task."""

    def voted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees = [pickle.loads(tree) for group in shared for tree in group.value]
        for part in parts:
            x = np.stack(part.to_numpy()) if len(part) else np.zeros((0, features))
            yield pd.Series(votes(trees, x))

    voted.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(voted, "double")


class ForestWriter(MLWriter):
    """A description of this class, and the files of Spark's model below `forest`."""

    def __init__(self, instance: StoredForest):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        for part, kind in (("metadata", "text"), ("treesMetadata", "parquet"), ("data", "parquet")):
            spark.read.format(kind).load(f"{self.instance.path}/{part}").write.format(kind).save(f"{path}/forest/{part}")


class ForestReader(MLReader):
    def load(self, path: str) -> StoredForest:
        DefaultParamsReader.loadMetadata(path, self.sparkSession, f"{StoredForest.__module__}.{StoredForest.__name__}")
        return StoredForest(f"{path}/forest")


@dataclass
class DeepForest:
    """Fits like the `RandomForestClassifier` it is made from: two classes, Gini, weighted rows, drawn with repeats."""

    like: RandomForestClassifier
    saved: str | None = None  # where the model is stored that was fitted last

    def fit(self, train: DataFrame) -> StoredForest | RandomForestClassificationModel:
        like, spark = self.like, train.sparkSession
        column, trees = like.getFeaturesCol(), like.getNumTrees()
        if train.agg(F.max("label")).first()[0] != 1:
            return like.fit(train)  # not two classes
        # a root fitted on a row of each class gives the files in which Spark describes a model of these settings and columns
        small, path = new_path(spark, "forest-frame"), new_path(spark, "deep-forest")
        form = train.select("label", like.getWeightCol(), column)
        one = form.first()
        frame = like.copy({like.maxDepth: 0, like.numTrees: 1, like.minInstancesPerNode: 1}).fit(
            spark.createDataFrame([(type(one[0])(label), 1.0, one[2]) for label in (0, 1)], form.schema))
        frame.write().save(small)
        attributes = train.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
        if any(len(a.get("vals", [])) > 2 for a in attributes.get("nominal", [])):
            return like.fit(train)  # Spark groups categories, this does not
        binary = {a["idx"] for kind in ("binary", "nominal") for a in attributes.get(kind, [])}
        features = frame.numFeatures
        share = {"all": features, "sqrt": (root := math.ceil(math.sqrt(features))), "auto": root if trees > 1 else features, "log2": max(1, math.ceil(math.log2(features)))}
        table = train.select("label", like.getWeightCol(), vector_to_array(column).alias("x"))
        rules = Rules(feature_thresholds(table, binary, features), like.getMaxDepth(), like.getMinInstancesPerNode(),
                      share[like.getFeatureSubsetStrategy()])

        def sort_in(batches):
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), features)
                bins = np.stack([np.searchsorted(t, x[:, f], "left") for f, t in enumerate(rules.thresholds)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("label"), batch.column("weight"),
                                                  pa.array([b.tobytes() for b in bins], pa.binary())], ["row", "label", "weight", "bins"])

        numbered = table.select(F.monotonically_increasing_id().alias("row"), F.col("label").cast("double").alias("label"),
                                F.col(like.getWeightCol()).cast("double").alias("weight"), "x")
        binned = stored(numbered.mapInArrow(sort_in, "row long, label double, weight double, bins binary"), "binned")
        upper = Upper(trees, like.getSeed(), like.getBootstrap())
        if binned.count() * 2 <= LOCAL_ROWS:
            upper.state = ["local"] * trees
        while upper.some("open"):
            split_level(binned, upper, rules)
        settings = {"maxDepth": like.getMaxDepth(), "numTrees": trees, "minInstancesPerNode": like.getMinInstancesPerNode()}
        write_model(spark, small, path, upper, grow_below(binned, upper, rules), rules, settings)
        self.saved = path
        return StoredForest(path)


def write_model(spark: SparkSession, frame: str, path: str, upper: Upper, below: DataFrame, rules: Rules, settings: dict) -> None:
    """The files of a model: as those of `frame`, a forest of one root, with the nodes of `upper` and `below`."""
    def deep(text: str, tree: int | None = None) -> str:
        told = json.loads(text)
        told["paramMap"] |= {k: v for k, v in settings.items() if k in told["paramMap"]}
        if tree is None:
            told["numTrees"] = upper.trees
        else:
            told["uid"] += f"_{tree}"
        return json.dumps(told)

    described = [deep(r["value"]) for r in spark.read.text(f"{frame}/metadata").collect()]
    spark.createDataFrame([(t,) for t in described], "value string").coalesce(1).write.text(f"{path}/metadata")
    about = spark.read.parquet(f"{frame}/treesMetadata")
    form = about.first()  # number, description and weight of a tree
    trees = [(n, deep(form[1], n), form[2]) for n in range(upper.trees)]
    spark.createDataFrame(trees, about.schema).coalesce(1).write.parquet(f"{path}/treesMetadata")

    sizes = {r["node"]: (r["n"], r["prediction"]) for r in below.groupBy("node").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("place") == 0, F.col("prediction"))).alias("prediction")).collect()}
    count, child = len(upper.tree), list(upper.child)
    guess = [sizes[k][1] if k in sizes else float(upper.stats[k][1] > upper.stats[k][0]) for k in range(count)]
    ended = lambda k: child[k] < 0 and sizes.get(k, (1,))[0] == 1
    gone = set()
    for k in reversed(range(count)):
        if child[k] >= 0 and ended(child[k]) and ended(child[k] + 1) and guess[child[k]] == guess[child[k] + 1]:
            gone |= {child[k], child[k] + 1}
            child[k] = -1
    for k in range(count):
        if k in gone and child[k] >= 0:
            gone |= {child[k], child[k] + 1}
    ids, following = {}, [0] * upper.trees
    for k in range(count):
        if k not in gone:
            ids[k] = following[upper.tree[k]]
            following[upper.tree[k]] += 1
    rows, moved = [], []
    for k in ids:
        tree = upper.tree[k]
        if k in sizes:
            moved.append((k, tree, ids[k], following[tree]))
            following[tree] += sizes[k][0] - 1
            continue
        inner, stats = child[k] >= 0, [float(x) for x in upper.stats[k]]
        rows.append((tree, ids[k], ids[child[k]] if inner else -1, ids[child[k] + 1] if inner else -1, upper.feature[k] if inner else -1,
                     float(rules.thresholds[upper.feature[k]][upper.cut[k]]) if inner else 0.0, float(upper.gain[k]) if inner else -1.0,
                     float(gini(upper.stats[k])), guess[k], stats[0], stats[1], round(stats[2])))
    columns = NODES.replace("node long, place long", "tree long, id long")
    top = spark.createDataFrame(rows, columns)
    at = F.broadcast(spark.createDataFrame(moved, "node long, tree long, top long, following long"))

    def number(place: str):
        return F.when(F.col(place) > 0, F.col("following") + F.col(place) - 1).when(F.col(place) == 0, F.col("top")).otherwise(-1)

    rest = below.join(at, "node").select("tree", number("place").alias("id"), number("left").alias("left"), number("right").alias("right"),
                                         *below.columns[4:])
    inner = F.col("left") >= 0
    split = F.struct(F.col("feature").alias("featureIndex"),
                     F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                     F.lit(-1).alias("numCategories"))
    node = F.struct(F.col("id").cast("int").alias("id"), "prediction", "impurity", F.array("negative", "positive").alias("impurityStats"),
                    F.col("raw").alias("rawCount"), "gain", F.col("left").cast("int").alias("leftChild"),
                    F.col("right").cast("int").alias("rightChild"), split.alias("split"))
    top.unionByName(rest).select(F.col("tree").cast("int").alias("treeID"), node.alias("nodeData")).write.parquet(f"{path}/data")
