"""Operator 12: ranked lexical search by dual trees over items and documents.

Documents and items are vectors over the items' terms; a score is their inner product. Both sides are arranged in trees whose
nodes hold the largest value of every coordinate, so the product of two nodes bounds all pairs below them. Where the bound is
under the weakest kth score of the items' side, the whole batch is skipped, and nothing that belongs to a result is lost.
Statistics cover all documents. What reaches a task is a part of the items of bounded size; documents stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.common import as_signed, flat, hash_spans, spans_between, stored, text_blocks

#: Items and words of items searched for at once; documents and coordinates in one tree; documents and items in a leaf;
#: about how many documents give the first lower bounds; bytes of a text that are read at once.
PART_ITEMS, PART_WORDS, TREE_ROWS, TREE_VALUES, LEAF, ITEM_LEAF, FANOUT = 256, 20_000, 8192, 2_000_000, 32, 8, 8
SEED_ROWS, SLICE_BYTES = 4096, 2_000_000
#: Parameters of the score, in hundredths and thousandths: length normalisation, saturation, and the scale of a term's share.
LENGTH_SHARE, SATURATION, SHARE_SCALE = 75, 8, 1_000_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Terms are runs of digits, letters and all bytes of other characters.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


# ---- terms --------------------------------------------------------------------------------------
def term_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hash of every term and the row it is in. A long text comes in slices, cut between terms."""
    data, offsets = flat(column)
    start = 0
    while True:
        end = len(data)
        edges = offsets
        if len(offsets) == 2 and end - start > SLICE_BYTES:
            end = start + SLICE_BYTES
            while end < len(data) and not BETWEEN[data[end]]:
                end += 1
        if len(offsets) == 2:
            edges = np.array([0, end - start])
        part = LOWER[data[start:end]]
        starts, ends, row = spans_between(part, edges, BETWEEN)
        yield hash_spans(part, starts, ends), row
        start = end
        if start >= len(data):
            return


def item_terms(benchmark: DataFrame, key: str, column: str) -> DataFrame:
    """(item_id, term, times) of every item; term is a 64-bit hash. Equal rows count once, rows of one id are one item."""

    def run(batches):
        for block in text_blocks(batches):
            for terms, row in term_hashes(block.column("text")):
                yield pa.record_batch([block.column("item_id").take(pa.array(row)), pa.array(as_signed(terms))], ["item_id", "term"])

    items = benchmark.select(F.col(key).alias("item_id"), F.col(column).alias("text")).where("text is not null").distinct()
    kind = items.schema["item_id"].dataType.simpleString()
    found = items.mapInArrow(run, f"item_id {kind}, term long")
    return stored(found.groupBy("item_id", "term").agg(F.count("*").alias("times")), "ranking-items")


# ---- documents ----------------------------------------------------------------------------------
@dataclass
class Corpus:
    """Term counts of the documents, only those of items' terms, and what the weights need."""

    counts: DataFrame
    documents: int
    terms: int


def count_terms(docs: DataFrame, wanted: np.ndarray, key: str) -> Corpus:
    """(doc_id, n, places, times) of every document with a term of the sorted hashes `wanted`, stored.

    One reading of the texts counts all terms; the totals of documents without a wanted term come as rows of a batch.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        terms = shared.value
        for block in text_blocks(batches):
            n = np.zeros(len(block), np.int64)
            parts = []
            for hashes, row in term_hashes(block.column("text")):
                n += np.bincount(row, minlength=len(block))
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                    good = terms[at] == hashes
                    parts.append(np.unique(row[good].astype(np.int64) * len(terms) + at[good], return_counts=True))
            codes = np.concatenate([c for c, _ in parts]) if parts else np.zeros(0, np.int64)
            times = np.concatenate([t for _, t in parts]) if parts else np.zeros(0, np.int64)
            if len(parts) > 1:
                codes, back = np.unique(codes, return_inverse=True)
                times = np.bincount(back, weights=times).astype(np.int64)
            row, place = np.divmod(codes, max(len(terms), 1))
            edges = np.searchsorted(row, np.arange(len(block) + 1))
            yield pa.record_batch([
                block.column(key), pa.array(n),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(place, pa.int32())),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(times, pa.int64()))],
                ["doc_id", "n", "places", "times"])

    found = docs.select(key, "text").mapInArrow(run, f"doc_id {kind}, n long, places array<int>, times array<long>")
    counts = stored(found.where("n > 0"), "ranking-counts")
    total = counts.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return Corpus(counts.where(F.size("places") > 0), total["documents"], total["terms"])


def document_frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each place's term; every task adds up one array first."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], ["place", "n"])

    out = np.zeros(size, np.int64)
    summed = counts.select("places").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    for place, n in summed.collect():
        out[place] = n
    return out


# ---- the trees ----------------------------------------------------------------------------------
class Items:
    """The tree over items. Items are in an order in which every node is a range; a node's row of `highs` holds the maxima."""

    def __init__(self, ids: list, weights: np.ndarray):
        """`weights` is items x coordinates."""
        order: list[int] = []
        self.nodes: list[tuple[int, int, list[int]]] = []  # first, end, children
        self.root = self._split(np.arange(len(ids)), weights, order) if len(ids) else -1
        self.ids = [ids[k] for k in order]
        # whole numbers this small add up in doubles without rounding, in any order
        self.exact = bool(weights.sum(axis=1).max(initial=0) * (SHARE_SCALE / 1000) < 2**53)
        self.weights = weights[order].astype(float if self.exact else np.int64)
        self.highs = np.array([self.weights[a:b].max(axis=0) for a, b, _ in self.nodes]).reshape(-1, weights.shape[1])

    def _split(self, rows: np.ndarray, weights: np.ndarray, order: list[int]) -> int:
        """Halves of like items, down to leaves: by the angle to two items that are far apart."""
        number = len(self.nodes)
        self.nodes.append((len(order), len(order) + len(rows), []))
        if len(rows) <= ITEM_LEAF:
            order.extend(rows.tolist())
            return number
        v = weights[rows].astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        first = int((v @ v[0]).argmin())
        second = int((v @ v[first]).argmin())
        by = np.argsort(v @ (v[second] - v[first]), kind="stable")
        half = len(rows) // 2
        self.nodes[number][2].extend([self._split(rows[by[:half]], weights, order), self._split(rows[by[half:]], weights, order)])
        return number


@dataclass
class Documents:
    """Some documents as sparse rows of coordinates; row r has those from edges[r] to edges[r + 1]."""

    ids: list
    edges: np.ndarray
    places: np.ndarray
    values: np.ndarray


class Search:
    """The k best of each item among all documents given so far."""

    def __init__(self, items: Items, k: int, floors: np.ndarray):
        """`floors` are scores below which nothing is wanted, by item in the order of `items`."""
        self.items, self.k = items, k
        self.least = np.maximum(floors.astype(np.int64), 1)
        self.best: list[list[tuple]] = [[] for _ in items.ids]
        self.pairs = 0

    def weakest(self, node: int) -> int:
        first, end, _ = self.items.nodes[node]
        return int(self.least[first:end].min())

    def bounds(self, rows: np.ndarray, used: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Products of rows of items (or of their maxima) with a document node: exact, as all are whole numbers."""
        if self.items.exact:
            return rows[:, used] @ high.astype(float)
        return (rows[:, used].astype(object) @ high.astype(object)).astype(float) * (1 + 1e-12)

    def add(self, docs: Documents) -> None:
        """Searches a tree built over the documents."""
        if self.items.root < 0 or not docs.ids:
            return
        order = self._order(docs)
        leaves = [order[at:at + LEAF] for at in range(0, len(order), LEAF)]
        level = [(*self._highs(docs, leaf), leaf, None) for leaf in leaves]
        while len(level) > 1:
            groups = [level[at:at + FANOUT] for at in range(0, len(level), FANOUT)]
            level = [(*_united(group), None, group) for group in groups]
        self._visit(docs, level[0], [self.items.root])

    def _order(self, docs: Documents) -> np.ndarray:
        """Like documents side by side: by the coordinates that could give most, the greatest first."""
        promise = docs.values * self.items.weights.max(axis=0)[docs.places]
        first = np.full((3, len(docs.ids)), -1, np.int64)
        row = np.repeat(np.arange(len(docs.ids)), np.diff(docs.edges))
        by = np.lexsort((docs.places, -promise, row))
        rank = np.arange(len(by)) - docs.edges[row[by]]
        for level in range(3):
            at = by[rank == level]
            first[level, row[at]] = docs.places[at]
        return np.lexsort((first[2], first[1], first[0]))

    def _highs(self, docs: Documents, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([np.arange(docs.edges[r], docs.edges[r + 1]) for r in rows])
        return _largest(docs.places[at], docs.values[at])

    def _visit(self, docs: Documents, node: tuple, asked: list[int]) -> None:
        """Compares a document node with item nodes; those that cannot hold a result are left here."""
        used, high, leaf, children = node
        nodes = self.items.nodes
        bound = self.bounds(self.items.highs[asked], used, high)
        kept = [i for i, b in zip(asked, bound, strict=True) if b >= self.weakest(i)]
        if leaf is None:
            # one step down on the items' side, then to the children
            finer = [c for i in kept for c in (nodes[i][2] or [i])]
            if finer:
                for child in children:
                    self._visit(docs, child, finer)
            return
        while any(nodes[i][2] for i in kept):
            finer = [c for i in kept for c in (nodes[i][2] or [i])]
            bound = self.bounds(self.items.highs[finer], used, high)
            kept = [i for i, b in zip(finer, bound, strict=True) if b >= self.weakest(i)]
        if kept:
            at = np.concatenate([np.arange(nodes[i][0], nodes[i][1]) for i in kept])
            at = at[self.bounds(self.items.weights[at], used, high) >= self.least[at]]
            if len(at):
                self._score(docs, leaf, at, used)

    def _score(self, docs: Documents, leaf: np.ndarray, at: np.ndarray, used: np.ndarray) -> None:
        """Exact scores of the leaf's documents for some items."""
        self.pairs += len(leaf) * len(at)
        if self.items.exact:
            block = np.zeros((len(leaf), len(used)))
            for k, row in enumerate(leaf):
                span = slice(docs.edges[row], docs.edges[row + 1])
                block[k, np.searchsorted(used, docs.places[span])] = docs.values[span]
            scores = (self.items.weights[np.ix_(at, used)] @ block.T).astype(np.int64)
        else:
            scores = np.array([[sum(int(self.items.weights[i, p]) * int(v) for p, v in zip(
                docs.places[docs.edges[r]:docs.edges[r + 1]], docs.values[docs.edges[r]:docs.edges[r + 1]], strict=True))
                for r in leaf] for i in at], np.int64)
        for line, item in enumerate(at):
            good = np.flatnonzero(scores[line] >= self.least[item])
            if len(good):
                found = [(-int(scores[line, g]), *_id_order(docs.ids[leaf[g]])) for g in good]
                best = sorted(self.best[item] + found)[:self.k]
                self.best[item] = best
                if len(best) == self.k:
                    self.least[item] = max(self.least[item], -best[-1][0])

    def results(self) -> Iterator[tuple]:
        """(place of the item, id of the document, score)."""
        for item, best in enumerate(self.best):
            for score, known, name in best:
                yield item, name if known else None, -score


def _id_order(name) -> tuple:
    """A null id is before all others."""
    return (False, 0) if name is None else (True, name)


def _largest(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places, sorted, each with its largest value."""
    by = np.argsort(places, kind="stable")
    places, values = places[by], values[by]
    edge = np.flatnonzero(np.diff(places, prepend=-1))
    return places[edge], np.maximum.reduceat(values, edge)


def _united(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return _largest(np.concatenate([n[0] for n in group]), np.concatenate([n[1] for n in group]))


# ---- the operator -------------------------------------------------------------------------------
def rank_documents(docs: DataFrame, benchmark: DataFrame, k: int = 10, key: str = "doc_id", item_key: str = "item_id",
                   column: str = "text", part_items: int = PART_ITEMS, part_words: int = PART_WORDS,
                   tree_rows: int = TREE_ROWS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """item_id, rank, doc_id, score: of every item the k documents with the highest scores above 0.

    Terms are runs of digits, letters (A to Z count as a to z) and characters beyond ASCII, compared by 64-bit hashes. Equal
    scores go by ascending doc_id, null first; repeated rows of documents are documents each. Equal rows of items count once,
    rows of one id are one item, and a null id is an item. Null and empty texts have no terms; an item without terms, or that
    no document shares a weighty term with, has no rows. Texts of any length are read whole, in slices. Other columns are
    ignored. For each part of the items (`part_items`, `part_words`) the texts are read once, and the stored counts of the part's
    terms four times.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"item_id {item_kind}, doc_id {kind}, score long"
    results = None
    terms = item_terms(benchmark, item_key, column)
    for part in _parts(terms, part_items, part_words):
        rows = part.collect()  # no more than `part_words` words, or one item
        wanted = np.unique(np.array([r["term"] for r in rows], np.int64).view(np.uint64))
        corpus = count_terms(docs, wanted, key)
        weights = _weights(document_frequencies(corpus.counts, len(wanted)), corpus.documents)
        items = _items(rows, wanted, weights)
        floors = np.zeros(len(items.ids), np.int64)
        if corpus.documents > 2 * seed_rows:
            share = int(seed_rows / corpus.documents * (1 << 30))
            some = corpus.counts.where(F.pmod(F.xxhash64("doc_id", "n", "places"), F.lit(1 << 30)) < share)
            floors = _floors(_searched(some, items, corpus, k, floors, tree_rows, schema), items, k)
        found = _searched(corpus.counts, items, corpus, k, floors, tree_rows, schema)
        results = found if results is None else results.unionByName(found)
    if results is None:
        results = spark.createDataFrame([], schema)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return results.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")


def _parts(terms: DataFrame, part_items: int, part_words: int) -> Iterator[DataFrame]:
    """The items' terms in parts of bounded size, dealt by a hash of the item; more parts until the largest is small enough."""
    sizes = terms.groupBy("item_id").agg(F.sum("times").alias("n"))
    n, words = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(1 if n else 0, -(-n // part_items), -(-words // part_words))
    while parts > 1:
        place = F.pmod(F.xxhash64("item_id"), F.lit(parts))
        full = sizes.groupBy(place.alias("part")).agg(F.count("*").alias("items"), F.sum("n").alias("n")).where(
            (F.col("items") > 1) & ((F.col("items") > 2 * part_items) | (F.col("n") > 2 * part_words)))
        if full.isEmpty():
            break
        parts *= 2
    for part in range(parts):
        yield terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)


def _weights(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequencies], np.int64)


def _items(rows: list, wanted: np.ndarray, weights: np.ndarray) -> Items:
    ids = sorted({r["item_id"] for r in rows}, key=_id_order)
    number = {name: k for k, name in enumerate(ids)}
    matrix = np.zeros((len(ids), len(wanted)), np.int64)
    places = np.searchsorted(wanted, np.array([r["term"] for r in rows], np.int64).view(np.uint64))
    for row, place in zip(rows, places, strict=True):
        matrix[number[row["item_id"]], place] = row["times"] * weights[place]
    return Items(ids, matrix)


def shares(n: np.ndarray, times: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A document's coordinates from its number of terms and a term's occurrences, in whole numbers rounded down."""
    if len(n) and int(n.max()) * documents * LENGTH_SHARE >= 2**63:
        length = np.array([LENGTH_SHARE * int(x) * documents // terms for x in n], np.int64)
    else:
        length = LENGTH_SHARE * n * documents // terms
    return (SHARE_SCALE * times) // (1000 * times + SATURATION * (100 - LENGTH_SHARE + length))


def _searched(counts: DataFrame, items: Items, corpus: Corpus, k: int, floors: np.ndarray, tree_rows: int,
              schema: str) -> DataFrame:
    """The k best of each item in every partition, with scores of at least the floors."""
    shared = counts.sparkSession.sparkContext.broadcast((items, floors, corpus.documents, corpus.terms))

    def run(batches):
        items, floors, documents, terms = shared.value
        search = Search(items, k, floors)
        waiting, rows, values = [], 0, 0

        def look() -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            places, times = (table.column(c).combine_chunks() for c in ("places", "times"))
            edges = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(places).to_numpy(), dtype=np.int64)))
            n = np.repeat(table.column("n").to_numpy(), np.diff(edges))
            search.add(Documents(table.column("doc_id").to_pylist(), edges, places.flatten().to_numpy().astype(np.int64),
                                 shares(n, times.flatten().to_numpy(), documents, terms)))

        for batch in batches:
            waiting.append(batch)
            rows += len(batch)
            values += len(batch.column(batch.schema.get_field_index("places")).flatten())
            if rows >= tree_rows or values >= TREE_VALUES:
                look()
                waiting, rows, values = [], 0, 0
        if waiting:
            look()
        found = list(search.results())
        yield pa.record_batch([
            pa.array([items.ids[i] for i, _, _ in found], schema_of["item_id"]),
            pa.array([d for _, d, _ in found], schema_of["doc_id"]),
            pa.array([s for _, _, s in found], pa.int64())], ["item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    schema_of = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)}
    return counts.mapInArrow(run, schema)


def _floors(found: DataFrame, items: Items, k: int) -> np.ndarray:
    """The kth score of each item among some documents: no result of all documents scores less."""
    best = Window.partitionBy("item_id").orderBy(F.desc("score"))
    rows = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("item_id", "score").collect()
    scores = {r["item_id"]: r["score"] for r in rows}
    return np.array([scores.get(name, 0) for name in items.ids], np.int64)
