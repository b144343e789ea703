"""Operator 6: near-duplicates by order MinHash on words, verified by banded alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import as_signed, flat, mix, stored, text_blocks, window_hashes, words
from keepwell.llm.components import components
from keepwell.llm.lines import KEY, with_key

#: Words of a shingle, least similarity, sketches of a document, and shingles in a sketch.
SHINGLE, SIMILARITY, SKETCHES, MINIMA = 5, 0.8, 24, 5
#: Texts of at most so many shingles are also filed by single shingles, as sketches often differ for them; cells of the
#: table of shingle frequencies.
SHORT, CELLS = 20, 1 << 18
_STEP = np.uint64(0x9FB21C651E98DF25)
_WIDE = 50_000
#: Words of a text that one step of an alignment covers, and turns in which texts of different classes meet centres only.
PART, TURNS = 4096, 3
#: 64-bit words of a text's parity bitmap.
PARITY = [f"p{k}" for k in range(8)]


def shingles(values: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words (of all words, if there are fewer) in text order. The n-th occurrence of a run has
    a hash of its own, so equal runs stay distinct."""
    found = window_hashes(values, max(1, min(size, len(values))))
    if not len(found):
        return found
    by = np.argsort(found, kind="stable")
    ordered = found[by]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    if new.all():
        return found
    first = np.flatnonzero(new)
    nth = np.arange(len(by)) - first[np.cumsum(new) - 1]
    label = np.empty(len(by), np.uint64)
    label[by] = nth.astype(np.uint64)
    return np.where(label > 0, mix(found + label * _STEP), found)


def sketch(found: np.ndarray, sketches: int = SKETCHES, minima: int = MINIMA) -> np.ndarray:
    """Order MinHash: for each of several hash functions the shingles with the smallest hashes, joined in text order."""
    if not len(found):
        return np.zeros(0, np.uint64)
    salts = mix(np.arange(1, sketches + 1, dtype=np.uint64) * _STEP)
    least = min(minima, len(found))
    chosen = np.empty((sketches, least), np.int64)
    for part in range(0, sketches, sketches if len(found) < _WIDE else 1):
        rows = slice(part, part + (sketches if len(found) < _WIDE else 1))
        order = mix(found[None, :] ^ salts[rows, None])
        chosen[rows] = np.argpartition(order, least - 1, axis=1)[:, :least]
    chosen.sort(axis=1)
    total = salts.copy()
    for k in range(least):
        total = mix(total * _STEP + found[chosen[:, k]])
    return total


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Insertions, deletions and replacements that turn a into b, inside a band of `limit` diagonals; None beyond it.

    The band is worked through in parts of b. Inside a part the rises and falls down a column are bits of two whole numbers,
    so a step is a few operations on as many bits as the band is wide, and memory is that of one part's masks. Rows that the
    band leaves count one more per step, which changes no path inside it.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    for turn in (1, -1):  # equal beginnings, equal ends
        least = min(len(a), len(b))
        differ = (a[::turn][:least] != b[::turn][:least])
        equal = int(differ.argmax()) if differ.any() else least
        a, b = (x[equal:] if turn > 0 else x[:len(x) - equal] for x in (a, b))
    rows, columns = a.tolist(), b.tolist()
    if not rows or not columns:
        return max(len(rows), len(columns))
    low = high = distance = up = down = 0
    for start in range(0, len(columns), PART):
        part = columns[start:start + PART]
        top, bottom = max(0, start - limit), min(len(rows), start + len(part) + limit)
        up = (up >> (top - low)) | (((1 << (bottom - high)) - 1) << (high - top))
        down >>= top - low
        distance += bottom - high
        low, high = top, bottom
        full, last = (1 << (high - low)) - 1, 1 << (high - low - 1)
        held: dict[int, int] = dict.fromkeys(part, 0)
        places: dict[int, list[int]] = {}
        for place, word in enumerate(rows[low:high]):
            if word in held:
                places.setdefault(word, []).append(place)
        for word, found in places.items():
            bits = np.zeros(found[-1] + 1, np.uint8)
            bits[found] = 1
            held[word] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        for word in part:
            equal = held[word]
            level = (((equal & up) + up) ^ up) | equal
            rise, fall = down | (full ^ ((level | up) & full)), up & level
            if rise & last:
                distance += 1
            elif fall & last:
                distance -= 1
            rise, across = ((rise << 1) | 1) & full, equal | down
            up = ((fall << 1) & full) | (full ^ ((across | rise) & full))
            down = rise & across
    return distance if distance <= limit else None


def sorted_shingles(values: np.ndarray) -> np.ndarray:
    return np.sort(as_signed(shingles(values)))


def jaccard(one: np.ndarray, other: np.ndarray, least: float) -> float:
    """Shared among all values of two sorted arrays without repeats; 0 when their sizes alone rule `least` out."""
    small, large = sorted((one, other), key=len)
    if not len(large) or len(small) < least * len(large):
        return 0.0
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = np.count_nonzero(large[at] == small)
    return shared / (len(small) + len(large) - shared)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, one: np.ndarray | None = None,
               other: np.ndarray | None = None) -> float:
    """The smaller of two shares, 0 when either is under `least`: shared shingles among all (Jaccard, occurrences counted),
    and 1 - edit distance / longer length, by banded alignment of the words. `one` and `other` are the sorted shingles, if known."""
    found = jaccard(sorted_shingles(a) if one is None else one, sorted_shingles(b) if other is None else other, least)
    if found < least:
        return 0.0
    longer = max(len(a), len(b))
    distance = edit_distance(a, b, int((1 - least) * longer + 1e-9))
    return 0.0 if distance is None else min(found, 1 - distance / longer)


def prefix(n: int, least: float) -> int:
    """How many of the n shingles of a text, the first in any one order, hold one of each text that is `least` like it."""
    return n - int(np.ceil(least * n - 1e-9)) + 1


def sketch_table(docs: DataFrame, sketches: int = SKETCHES, minima: int = MINIMA, least: float = SIMILARITY) -> DataFrame:
    """key, digest binary, n (shingles), sketch array<long>, single array<long> of every row; no sketch without words.
    Two texts of which one has at most SHORT shingles share one of `single`, if they are `least` alike."""

    def run(batches):
        for block in text_blocks(batches):
            data, offsets = flat(block.column("text"))
            _, _, values, first = words(data, offsets)
            found = [shingles(values[s:e]) for s, e in zip(first[:-1], first[1:], strict=True)]
            single = [as_signed(np.sort(x)[:prefix(len(x), least)] if 0 < len(x) * least <= SHORT else x[:0]) for x in found]
            yield pa.record_batch([block.column("key"), block.column("digest"), pa.array([len(x) for x in found], pa.int32()), pa.array(
                [as_signed(sketch(x, sketches, minima)) for x in found], pa.list_(pa.int64())), pa.array(single, pa.list_(pa.int64()))],
                ["key", "digest", "n", "sketch", "single"])

    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
    return with_key(docs).select("key", digest, "text").mapInArrow(
        run, f"{KEY}, digest binary, n int, sketch array<long>, single array<long>")


def word_table(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """key, words array<int> (32-bit hashes), shingles array<long> (of these, sorted) of the chosen keys."""
    rows = with_key(docs).select("key", "text").join(chosen, "key", "left_semi")

    def run(batches):
        for block in text_blocks(batches):
            data, offsets = flat(block.column("text"))
            _, _, values, first = words(data, offsets)
            short = (values >> np.uint64(32)).astype(np.uint32).view(np.int32)
            wide = short.astype(np.int64).astype(np.uint64)
            found = [sorted_shingles(wide[s:e]) for s, e in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch([block.column("key"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(short)),
                                   pa.array(found, pa.list_(pa.int64()))], ["key", "words", "shingles"])

    return rows.mapInArrow(run, f"{KEY}, words array<int>, shingles array<long>").dropDuplicates(["key"])


def arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column without nulls."""
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(), ends[:-1])


def verified(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """a, b, similarity of the pairs that are similar enough."""
    one, other = (sequences.toDF(x, f"words_{x}", f"shingles_{x}") for x in "ab")
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "words_a", "words_b", "shingles_a", "shingles_b")

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            lists = [arrays(batch.column(c)) for c in ("words_a", "words_b", "shingles_a", "shingles_b")]
            found = [similarity(a, b, least, one, other) for a, b, one, other in zip(*lists, strict=True)]
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    schema = f"{KEY.replace('key', 'a', 1)}, {KEY.replace('key', 'b', 1)}, similarity double"
    return both.mapInArrow(run, schema).where(F.col("similarity") > 0)


def frequencies(sequences: DataFrame) -> np.ndarray:
    """How many texts hold a shingle of each cell. The table has a fixed size, 1 MB; shingles of one cell count together."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("shingles").flatten().to_numpy() & (CELLS - 1), minlength=CELLS)
        found = np.flatnonzero(total)
        for part in range(0, len(found), 1 << 14):
            cells = found[part:part + (1 << 14)]
            yield pa.record_batch([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    summed = sequences.select("shingles").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[summed.column("cell").to_numpy()] = summed.column("n").to_numpy()
    return out


def prefixes(sequences: DataFrame, least: float) -> DataFrame:
    """key, shingle, rank, place, length, p0 to p7: of the texts with key, shingles, the first shingles from the rarest, as many
    as hold one of each text whose Jaccard reaches `least`; where it stands among the text's, and how many these are. The
    parity bitmap has a bit for the shingles of each of 512 cells: is their number odd? Two bitmaps differ in no more bits than
    the texts in shingles."""
    shared = sequences.sparkSession.sparkContext.broadcast(frequencies(sequences))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            values, owner, place, size, bits = [], [], [], [], []
            for row, x in enumerate(arrays(batch.column("shingles"))):
                first = prefix(len(x), least)
                odd = np.bincount((x >> 20) & (64 * len(PARITY) - 1), minlength=64 * len(PARITY)) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                values.append(x[np.lexsort((x, shared.value[x & (CELLS - 1)]))[:first]])
                owner.append(np.full(first, row))
                place.append(np.arange(first))
                size.append(np.full(first, len(x)))
            at, value = pa.array(np.concatenate(owner)), np.concatenate(values)
            yield pa.record_batch([
                batch.column("key").take(at), pa.array(value), pa.array(shared.value[value & (CELLS - 1)]),
                pa.array(np.concatenate(place), pa.int32()), pa.array(np.concatenate(size), pa.int32()),
                *(pa.array(p).take(at) for p in np.array(bits).T)], ["key", "shingle", "rank", "place", "length", *PARITY])

    kinds = f"{KEY}, shingle long, rank long, place int, length int, " + ", ".join(f"{p} long" for p in PARITY)
    return sequences.select("key", "shingles").mapInArrow(run, kinds)


def alike(first: DataFrame, classes: DataFrame, least: float, turn: int | None = None) -> DataFrame:
    """a, b: of the texts of `prefixes`, all pairs of different components (of `classes`: key, component) whose Jaccard may
    reach `least`; given a turn, only those with the centre of a shingle, the text with the smallest hash for that shingle and turn.

    Two texts that are `least` alike share one of their first shingles, and the first one they share leaves room for as many
    as they must share behind it in both. So a shingle of a frequent passage only pairs texts that consist of little else. Nor
    do their bitmaps differ in more bits than they may in shingles. Texts of a shingle's largest component meet the others, not each other; of several shingles held by the same texts the
    rarest is enough.
    """
    first = first.join(classes, "key", "left").withColumn("component", F.coalesce("component", "key"))
    sizes = first.groupBy("component").agg(F.countDistinct("key").alias("n"))
    own = ["key", "component", "place", "length", *PARITY]
    text = F.struct(*(F.col(c).alias(f"other_{c}") for c in own))
    centre = F.struct(F.xxhash64("key", "shingle", F.lit(turn or 0)).alias("hash"), text.alias("text"))
    held = first.join(sizes, "component").groupBy("shingle").agg(
        F.min("rank").alias("rank"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("key")).alias("mark"), F.max(F.struct("n", "component"))["component"].alias("major"),
        F.min(centre)["text"].alias("centre")).where("low <> high")
    rarest = held.groupBy("n", "mark").agg(F.min(F.struct("rank", "shingle", "major", "centre")).alias("least")).select(
        "least.shingle", "least.major", "least.centre")
    first = first.drop("rank").join(rarest, "shingle")
    if turn is None:
        first = stored(first.drop("centre"), "prefixes")
        first = first.where("component <> major").join(first.select("shingle", text.alias("centre")), "shingle")
    first = first.select(*own, "centre.*")
    both = F.col("length") + F.col("other_length")
    room = F.least(F.col("length") - F.col("place"), F.col("other_length") - F.col("other_place"))
    enough = room + F.lit(1e-6) >= least / (1 + least) * both
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"other_{p}"))) for p in PARITY), F.lit(0))
    met = first.where((F.col("component") != F.col("other_component")) & enough & (apart <= (1 - least) / (1 + least) * both + F.lit(1e-6)))
    return met.select(F.least("key", "other_key").alias("a"), F.greatest("key", "other_key").alias("b")).distinct()


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES,
                    minima: int = MINIMA) -> DataFrame:
    """key, class_key, for every row: the class of near-duplicates it is in, named by its smallest key.

    Equal texts are one text. Different texts that share a sketch (or, with few shingles, one of some single shingles) are
    candidates. First each text of a bucket meets the bucket's centre, the text with the smallest hash in one of five orders,
    and the links found make classes. Then the texts of all buckets that still hold different classes meet every text of
    another class that can be similar by its shingles (`alike`), so no link between classes is missed. A bucket of
    copies costs one pair each, not all pairs, and the last step is taken once turns of new centres have made the classes
    few. Texts whose numbers of shingles alone rule the similarity out don't meet. Empty
    and null texts are equal; texts of fewer words than a shingle have one shingle. Reads `docs` twice.
    """
    table = stored(sketch_table(docs, sketches, minima, least), "sketches")
    texts = stored(table.groupBy("digest").agg(F.min(F.struct("key", "n", "sketch", "single")).alias("least")).select(
        "digest", "least.key", F.col("least.n").alias("length"), "least.sketch", "least.single"), "texts")
    filed = F.concat(F.transform("sketch", lambda value, band: F.struct(band.alias("band"), value.alias("value"))),
                     F.transform("single", lambda value: F.struct(F.lit(-1).alias("band"), value.alias("value"))))
    exploded = texts.select("key", "length", F.explode(filed).alias("bucket"))
    # few orders of the texts, so that near copies meet few different centres
    place = F.xxhash64("key", F.col("bucket.band") % 4).alias("place")
    members = exploded.select("bucket", "key", "length", place)
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("place").alias("centre")).where("n > 1")
    members = stored(members.join(sizes, "bucket"), "buckets")
    sequences = stored(word_table(docs, members.select("key").distinct()), "sequences")
    near_length = F.least("length", "other_length") >= least * F.greatest("length", "other_length")
    found = members.where("place = centre").select("bucket", F.col("key").alias("other"), F.col("length").alias(
        "other_length")).join(members, "bucket").where("key <> other")
    pairs = found.where(near_length).select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
    tested = stored(pairs, "pairs")
    classes = components(stored(verified(tested, sequences, least), "verified").select("a", "b"))
    members = members.where("n > 2").join(classes, "key", "left").select(
        "bucket", "key", F.coalesce("component", "key").alias("component"))
    mixed = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    left = stored(members.join(mixed.select("bucket"), "bucket", "left_semi").select("key", "component").distinct(), "mixed")
    if not left.isEmpty():
        first = stored(prefixes(stored(sequences.join(left.select("key"), "key", "left_semi"), "chosen"), least), "prefixes")
        for turn in [*range(TURNS), None]:
            pairs = stored(alike(first, classes, least, turn).join(tested, ["a", "b"], "left_anti"), "pairs")
            good = stored(verified(pairs, sequences, least), "verified").select("a", "b")
            if not good.isEmpty():  # earlier links are known by their classes
                classes = components(good.union(classes.where("key <> component").select("key", "component")))
            tested = tested.union(pairs)
    named = texts.select("digest", F.col("key").alias("text_key"))
    out = table.select("key", "digest").join(named, "digest")
    return out.join(classes.withColumnRenamed("key", "text_key"), "text_key", "left").select("key", F.coalesce("component", "text_key").alias("class_key"))


def dedup_documents(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class of near-duplicates, with all columns as they were: that of the smallest id (then text hash)."""
    kept = near_duplicates(docs, least).where("key = class_key").select("key").distinct()
    rows = with_key(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")).select("key", "row")
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
