"""Operator 10: best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import os
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.bpe import byte_characters
from keepwell.llm.common import stored, text_blocks

CAPACITY, SHARD_PIECES, ISLANDS, EPOCHS = 2048, 2048, 2, 2
POPULATION, GENERATIONS, ELITE = 6, 12, 2

Bins = list[list[int]]
_LOADED: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """The ids that a byte-level `tokenizers` file gives a text. The ids of such a file are its merge ranks, so the faster
    rank-based encoder gives the same; tests compare both over every character. Texts that its splitter can't finish (very
    long white space) go to the `tokenizers` library itself."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        place = {character: byte for byte, character in enumerate(byte_characters())}
        special = {token.content for token in self.exact.get_added_tokens_decoder().values()}
        ranks = {bytes(place[c] for c in token): i for token, i in self.exact.get_vocab().items() if token not in special}
        self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.quick.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(path, pattern)
    return _LOADED[path, pattern]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row's tokens and the end id.

    Longer documents are cut into pieces of `capacity` tokens, of which the first may be shorter. Null and empty texts are
    the end id alone. Repeated rows give pieces each; other columns are ignored.
    """

    def run(batches):
        own = encoder(path, pattern)
        for block in text_blocks(batches):
            out: list[tuple] = []
            for doc_id, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
                whole = np.append(own.encode(text or ""), end_id).astype("<u4")
                cuts = [0, *range(len(whole) % capacity or capacity, len(whole) + 1, capacity)]
                out += [(doc_id, k, s, e - s, zlib.crc32(whole[s:e].tobytes()))
                        for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                  ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece long, start long, length long, ids_crc32 long").withColumn("piece", F.col("piece").cast("int"))


class Open:
    """Bins by free space, for best fit in logarithmic time."""

    def __init__(self, sizes: list[int], capacity: int, bins: Bins):
        self.sizes, self.capacity, self.bins = sizes, capacity, bins
        self.free = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))

    def put(self, item: int) -> None:
        at = bisect_left(self.free, (self.sizes[item], -1))
        if at == len(self.free):
            self.bins.append([item])
            insort(self.free, (self.capacity - self.sizes[item], len(self.bins) - 1))
            return
        space, k = self.free.pop(at)
        self.bins[k].append(item)
        insort(self.free, (space - self.sizes[item], k))


def best_fit(sizes: list[int], capacity: int, bins: Bins, items: list[int]) -> Bins:
    """The bins with the items added, largest first, each to the fullest bin that still has room."""
    state = Open(sizes, capacity, [list(b) for b in bins])
    for item in sorted(items, key=lambda i: (-sizes[i], i)):
        state.put(item)
    return state.bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: by total size, and by items over half a bin with those that don't fit beside them."""
    ordered = np.sort(np.array(sizes, np.int64))
    if not len(ordered):
        return 0
    total = np.concatenate(([0], np.cumsum(ordered)))
    half = np.searchsorted(ordered, capacity / 2, "right")
    # for each small size: items too large to stand beside it, large items that could, and the small ones from it on
    small = np.unique(ordered[:half])
    beside_end = np.maximum(np.searchsorted(ordered, capacity - small, "right"), half)
    room = (beside_end - half) * capacity - (total[beside_end] - total[half])
    rest = total[half] - total[np.searchsorted(ordered, small, "left")]
    bounds = len(ordered) - half + np.maximum(0, -((room - rest) // capacity))
    return int(max(-(-total[-1] // capacity), len(ordered) - half, *bounds))


def fitness(sizes: list[int], capacity: int, bins: Bins) -> tuple[int, float]:
    """Fewer bins first, then bins as unequally filled as can be."""
    return len(bins), -sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(sizes: list[int], capacity: int, one: Bins, other: Bins, chance: random.Random) -> Bins:
    """Whole well-filled bins of `other` enter `one`; bins that share a document with them go, and what those held besides
    is placed anew by best fit. A few of the emptiest bins are dissolved, too."""
    ranked = sorted(other, key=lambda b: (-sum(sizes[i] for i in b), b))
    injected = chance.sample(ranked[:max(1, len(ranked) // 2)], max(1, len(ranked) // 4))
    taken = {i for b in injected for i in b}
    kept = [b for b in one if not taken.intersection(b)]
    kept.sort(key=lambda b: (sum(sizes[i] for i in b), b))
    kept = kept[min(len(kept), 1 + chance.randrange(4)):]
    held = taken.union(i for b in kept for i in b)
    return best_fit(sizes, capacity, injected + kept, [i for i in range(len(sizes)) if i not in held])


def evolve(sizes: list[int], capacity: int, population: list[Bins], seed: int) -> list[Bins]:
    """Some generations on one island. Ends at once when the lower bound is met."""
    chance, bound, everything = random.Random(seed), lower_bound(sizes, capacity), list(range(len(sizes)))
    score = lambda b: (fitness(sizes, capacity, b), b)
    if not population:
        population = [best_fit(sizes, capacity, [], everything)]
    while len(population) < POPULATION and min(map(len, population)) > bound:
        start = chance.sample(everything, len(everything) // 3)
        state = Open(sizes, capacity, [])
        for item in start:
            state.put(item)
        held = set(start)
        population.append(best_fit(sizes, capacity, state.bins, [i for i in everything if i not in held]))
    population.sort(key=score)
    for _ in range(GENERATIONS):
        if len(population[0]) <= bound:
            break
        children = [crossover(sizes, capacity, *chance.sample(population, 2), chance) for _ in range(POPULATION)]
        population = sorted(population + children, key=score)[:POPULATION]
    return population[:ELITE]


def labels(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, items in enumerate(bins):
        for i in items:
            out[i] = k
    return out


def from_labels(given: list[int]) -> Bins:
    out: Bins = [[] for _ in range(max(given, default=-1) + 1)]
    for i, k in enumerate(given):
        out[k].append(i)
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS,
         epochs: int = EPOCHS) -> DataFrame:
    """The pieces with sequence_id and offset, in few sequences of at most `capacity` tokens.

    Pieces are dealt by a hash of the row and its place into shards of about `shard_pieces`, so rows of one id are dealt, too.
    Each shard is packed by best fit; where that misses the lower bound it is solved on `islands` islands, which after each
    epoch send their elite to the next island, and the best packing of the shard stays. A shard that meets its bound is done.
    Pieces of full length fill a sequence alone. Read twice: give a stored table. Equal rows are different pieces, and pieces
    of equal length go by id. No pieces give no rows.
    """
    shards = max(1, -(-cut.count() // shard_pieces))
    tasks = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    shard = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards))
    table = cut.select(shard.alias("shard"), F.struct("length", "doc_id", "piece", "start", "ids_crc32").alias("item"))
    table = stored(table.groupBy("shard").agg(F.sort_array(F.collect_list("item")).alias("items")), "pack-shards")
    kinds = "shard long, sizes array<long>, island int, epoch int, found array<array<int>>, bins int, settled boolean"

    def first(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples():
                sizes = [int(s) for s in row.sizes if s < capacity]
                bins = best_fit(sizes, capacity, [], list(range(len(sizes))))
                rows.append((row.shard, row.sizes, 0, -1, [labels(bins, len(sizes))], len(bins), len(bins) <= lower_bound(sizes, capacity)))
            yield pd.DataFrame(rows, columns=["shard", "sizes", "island", "epoch", "found", "bins", "settled"])

    found = stored(table.select("shard", F.col("items.length").alias("sizes")).mapInPandas(first, kinds), "pack-first")
    solved = found
    state = found.where("not settled").select("shard", "sizes", F.col("found").alias("elite"),
                                              F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    for epoch in range(epochs):
        def run(frames, epoch=epoch):
            for frame in frames:
                rows = []
                for row in frame.itertuples():
                    sizes = [int(s) for s in row.sizes if s < capacity]
                    best = evolve(sizes, capacity, [from_labels([int(k) for k in e]) for e in row.elite],
                                  (int(row.shard) * 31 + row.island) * 31 + epoch)
                    bound = lower_bound(sizes, capacity)
                    rows.append((row.shard, row.sizes, row.island, epoch, [labels(b, len(sizes)) for b in best],
                                 len(best[0]), len(best[0]) <= bound))
                yield pd.DataFrame(rows, columns=["shard", "sizes", "island", "epoch", "found", "bins", "settled"])

        if state.isEmpty():
            break
        # a set number of partitions: the rows are few and small, but each takes long
        found = stored(state.repartition(tasks, F.col("shard"), F.col("island")).mapInPandas(run, kinds), "pack-epoch")
        solved = solved.union(found)
        # the elite of an island goes to itself and to the next one
        send = found.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)))))
        state = send.groupBy("shard", "island").agg(F.first("sizes").alias("sizes"), F.flatten(F.collect_list("found")).alias("elite"),
                                                    F.max("settled").alias("settled")).where("not settled").drop("settled")
    best = solved.groupBy("shard").agg(F.min_by(F.element_at("found", 1), F.struct("bins", "epoch", "island")).alias("label"))

    def place(frames):
        for frame in frames:
            rows = []
            for shard_id, items, label in zip(frame["shard"], frame["items"], frame["label"], strict=True):
                used: dict[int, int] = {}
                base, alone, k = int(shard_id) << 24, 1 << 23, 0
                for item in items:
                    if item["length"] >= capacity:
                        sequence, alone = alone, alone + 1
                    else:
                        sequence, k = int(label[k]), k + 1
                    rows.append((item["doc_id"], item["piece"], item["start"], item["length"], item["ids_crc32"],
                                 base + sequence, used.get(sequence, 0)))
                    used[sequence] = used.get(sequence, 0) + item["length"]
            yield pd.DataFrame(rows, columns=[*columns, "sequence_id", "offset"]).astype({"doc_id": "Int64"})

    return table.join(best, "shard").select("shard", "items", "label").mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's pieces, packed."""
    return pack(stored(pieces(docs, path, pattern, capacity), "pack-pieces"), capacity)
