"""Connected components of links between documents, as Spark jobs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import stored

#: So many links left after a round, about 3 MB, are finished in one task.
FEW = 50_000


def finished(links: DataFrame) -> DataFrame:
    """key, component of a few links, in one task: every key points to another of its component until it finds the root."""

    def run(batches):
        up: dict[tuple, tuple] = {}

        def root(key: tuple) -> tuple:
            while up.setdefault(key, key) != key:
                up[key] = up[up[key]]
                key = up[key]
            return key

        kind = None
        for batch in batches:
            kind = batch.column("a").type
            for one, other in zip(*(batch.column(c).to_pylist() for c in "ab"), strict=True):
                up[root(tuple(one.items()))] = root(tuple(other.items()))
        if kind is not None:
            keys = [[dict(k) for k in up], [dict(root(k)) for k in up]]
            yield pa.record_batch([pa.array(x, kind) for x in keys], ["key", "component"])

    kind = links.schema["a"].dataType.simpleString()
    return links.coalesce(1).mapInArrow(run, f"key {kind}, component {kind}")


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """key, component (its smallest key) of every end of the links (a, b); keys are structs.

    Local contraction: each round every key moves to the first key, in a random order of the round, among its neighbours and
    itself; links between keys that met are gone, equal links become one. So the links shrink with every round, a star is gone
    after one or two, and a chain takes about the logarithm of its length. Once a round leaves at most `few` links one task
    finishes them, as more rounds would cost more than they do. The moves are put together from the last, smallest
    round back. Links and moves go through the shared folder. Without links there are no rows.
    """
    links = links.select("a", "b").where("a <> b")
    moves: list[DataFrame] = []
    while True:
        both = links.union(links.select("b", "a")).toDF("key", "near")
        near, own = (F.struct(F.xxhash64(c, F.lit(len(moves))).alias("place"), F.col(c).alias("key")) for c in ("near", "key"))
        step = both.groupBy("key").agg(F.min(near).alias("near")).select("key", F.least("near", own)["key"].alias("component"))
        moves.append(step := stored(step, "moves"))
        ends = [step.toDF(x, f"{x}_at") for x in "ab"]
        moved = links.join(ends[0], "a").join(ends[1], "b").where("a_at <> b_at")
        links = stored(moved.select(F.least("a_at", "b_at").alias("a"), F.greatest("a_at", "b_at").alias("b")).distinct(), "links")
        left = links.count()
        if left <= few:
            break
    if left:
        moves.append(finished(links))
    labels = moves[-1]
    for step in reversed(moves[:-1]):
        further = labels.toDF("component", "further")
        labels = step.join(further, "component", "left").select("key", F.coalesce("further", "component").alias("component"))
    labels = stored(labels, "labels") if len(moves) > 2 else labels
    least = labels.groupBy("component").agg(F.min("key").alias("least"))
    return stored(labels.join(least, "component").select("key", F.col("least").alias("component")), "labels")
