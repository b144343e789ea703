"""Operator 1: nearest neighbours by vantage-point trees, one per shard, pruned by the triangle inequality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK = 8192, 256, 512
#: Rounding of distances: a branch is only left when it is farther by more than this share of the largest norm.
SLACK = 1e-6


@dataclass
class Node:
    """Rows start to end of the tree's order; `near` and `far` are the distances of each child's rows from the vantage point."""

    start: int
    end: int
    point: np.ndarray | None = None
    near: tuple[float, float] = (0.0, 0.0)
    far: tuple[float, float] = (0.0, 0.0)
    inner: Node | None = None
    outer: Node | None = None


class Tree:
    """A vantage-point tree. Inner products become distances: each vector gets one more component, such that all have the norm
    of the longest; then the nearest are those with the largest inner product."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        squares = (vectors * vectors).sum(axis=1)
        self.ids, self.vectors = ids, vectors
        self.radius = float(np.sqrt(squares.max()))
        self.points = np.hstack([vectors, np.sqrt(np.maximum(self.radius**2 - squares, 0))[:, None]])
        self.order = np.arange(len(ids))
        self.leaf = leaf
        self.root = self.build(0, len(ids))
        self.ids, self.vectors, self.points = self.ids[self.order], self.vectors[self.order], self.points[self.order]

    def build(self, start: int, end: int) -> Node:
        node, rows = Node(start, end), self.order[start:end]
        if end - start <= self.leaf:
            return node
        # the row farthest from the middle sees the others at the most different distances
        centre = self.points[rows].mean(axis=0)
        node.point = self.points[rows[((self.points[rows] - centre) ** 2).sum(axis=1).argmax()]].copy()
        distance = np.sqrt(((self.points[rows] - node.point) ** 2).sum(axis=1))
        by = np.argsort(distance, kind="stable")
        self.order[start:end], distance = rows[by], distance[by]
        middle = len(by) // 2
        node.near, node.far = (distance[0], distance[middle - 1]), (distance[middle], distance[-1])
        node.inner, node.outer = self.build(start, start + middle), self.build(start + middle, end)
        return node

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of each query: (places in the tree's order, inner products), the k-th best last, -1 and -inf where
        there are fewer. Which of several rows at the k-th inner product are found is not set. Works on all queries at once;
        at each node only those go on for which it may hold something better. factor 1 is exact; a larger one leaves a
        branch already when its nearest possible row is farther than the k-th found divided by the factor."""
        n = len(queries)
        points = np.hstack([queries, np.zeros((n, 1))])
        size = (queries * queries).sum(axis=1)
        best = np.full((n, k), -np.inf)
        names = np.full((n, k), -1, np.int64)
        scale = self.radius + float(np.sqrt(size.max(initial=0)))

        def reach(active: np.ndarray) -> np.ndarray:
            """Distance of the k-th found, from its inner product."""
            worst = best[active, -1]
            square = size[active] + self.radius**2 - 2 * np.where(np.isfinite(worst), worst, 0)
            return np.where(np.isfinite(worst), np.sqrt(np.maximum(square, 0)), np.inf)

        def visit(node: Node, active: np.ndarray) -> None:
            if not len(active):
                return
            if node.point is None:
                rows = slice(node.start, node.end)
                score = queries[active] @ self.vectors[rows].T
                score[own[active][:, None] == self.ids[rows][None, :]] = -np.inf
                scores = np.hstack([best[active], score])
                places = np.hstack([names[active], np.broadcast_to(np.arange(node.start, node.end), score.shape)])
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                best[active] = np.take_along_axis(scores, top, 1)
                names[active] = np.where(np.isfinite(best[active]), np.take_along_axis(places, top, 1), -1)
                return
            distance = np.sqrt(((points[active] - node.point) ** 2).sum(axis=1))
            gaps = [np.maximum(np.maximum(low - distance, distance - high), 0) for low, high in (node.near, node.far)]
            first_inner = gaps[0] <= gaps[1]
            for inner_turn in (True, False):
                # the likelier child of each query first
                for mask in (first_inner, ~first_inner):
                    inner = inner_turn == bool(mask is first_inner)
                    gap, child = (gaps[0], node.inner) if inner else (gaps[1], node.outer)
                    group = active[mask]
                    visit(child, group[gap[mask] * factor <= reach(group) + SLACK * scale])

        visit(self.root, np.arange(n))
        return names, best


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added component by component."""
    total = np.zeros(len(queries))
    for k in range(queries.shape[1]):
        total = total + queries[:, k] * rows[:, k]
    return total


def found_rows(tree: Tree, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of the tree for each query by exact score, ties to the smaller id: (query, place in the tree, score).

    The search rounds differently from the score, so it is asked for a few rows more than k. Where the last row that it
    gave may still tie with the k-th, by the rounding error of an inner product, the query is asked again for twice as many."""
    out, open_, asked = [], np.arange(len(queries)), k + 4
    while len(open_):
        asked = min(asked, len(tree.ids))
        names, rough = tree.search(queries[open_], own[open_], asked, factor)
        at, column = np.nonzero(names >= 0)
        place = names[at, column]
        score = exact_scores(queries[open_][at], tree.vectors[place])
        by = np.lexsort((tree.ids[place], -score, at))
        at, place, score = at[by], place[by], score[by]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        size = np.sqrt((queries[open_] ** 2).sum(axis=1))
        margin = 4 * queries.shape[1] * np.finfo(float).eps * size * tree.radius
        kth = np.full(len(open_), -np.inf)
        kth[at[nth == k - 1]] = score[nth == k - 1]
        last = rough[:, -1]
        done = (asked == len(tree.ids)) | ~np.isfinite(last) | (last < kth - margin)
        good = (nth < k) & done[at]
        out.append((open_[at[good]], place[good], score[good]))
        open_, asked = open_[~done], 2 * asked
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (own[:0], own[:0], np.zeros(0))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles and its size, without vectors that are null, zero, or hold a null or non-finite component."""
    value = F.col("embedding").cast("array<double>")
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.select("vec_id", value.alias("embedding")).where(
        F.col("vec_id").isNotNull() & good & F.exists("embedding", lambda x: x != 0.0))


def nearest(embeddings: DataFrame, is_query, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: of every row for which `is_query` holds, its k largest inner products among all others.

    Vectors that are null, zero, or hold a null or non-finite component take no part, and a query meets only vectors of its
    own length. Ties go to the smaller vec_id, however many there are. Rows of a repeated id are candidates each, but never of
    their own id; as queries they share one list of k. Null ids take no part, other columns are ignored. The rows are dealt into shards of about `shard_rows`; each shard's tree is built in one task and meets the queries in blocks.
    Reads the table twice.
    """
    rows = usable(embeddings)
    shards = max(1, -(-rows.count() // shard_rows))
    size = F.size("embedding")
    held = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), size.alias("size"), F.lit(0).alias("asks"),
                       F.lit(0).alias("block"), "vec_id", "embedding")
    blocks = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(1 << 16)).cast("int")
    asked = rows.where(is_query).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                                        size.alias("size"), F.lit(1).alias("asks"), blocks.alias("block"), "vec_id", "embedding")
    dealt = held.unionByName(asked).repartition(F.col("shard"), F.col("size")).sortWithinPartitions(
        "shard", "size", "asks", "block", "vec_id")

    def run(batches):
        tree, key, kept = None, None, []

        def matrix(part: pa.RecordBatch, width: int) -> np.ndarray:
            return part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

        for batch in batches:
            shard, width, asks = (batch.column(c).to_numpy() for c in ("shard", "size", "asks"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(width) != 0) | (np.diff(asks) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                part, own = batch.slice(start, end - start), (shard[start], width[start])
                if own != key:
                    tree, key, kept = None, own, []
                ids, vectors = part.column("vec_id").to_numpy(), matrix(part, int(width[start]))
                if not asks[start]:
                    kept.append((ids, vectors))
                    continue
                if tree is None and kept:
                    tree, kept = Tree(np.concatenate([i for i, _ in kept]), np.vstack([v for _, v in kept])), []
                if tree is None:
                    continue
                for at in range(0, len(ids), QUERY_BLOCK):
                    q, v = ids[at:at + QUERY_BLOCK], vectors[at:at + QUERY_BLOCK]
                    query, place, score = found_rows(tree, v, q, k, factor)
                    yield pa.record_batch([pa.array(q[query]), pa.array(tree.ids[place]), pa.array(score)],
                                          ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
