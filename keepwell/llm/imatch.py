"""Operator 8: I-Match fingerprints with several randomised lexicons, and a comparison with edited texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import hash_spans, mix, spans_between, text_blocks

#: Cells of the document-frequency table, the band of inverse document frequency (natural logarithm of rows over documents
#: of the term), lexicons per density, and the fewest terms in the band (with fewer, all terms of the text count).
CELLS, LOW_IDF, HIGH_IDF, LEXICONS, LEAST_TERMS = 1 << 20, 4.0, 40.0, 48, 8
ROWS_PER_RANGE = 4000
_SPLIT = np.uint64(0xC2B2AE3D27D4EB4F)
_NO_TERM = np.ones(256, bool)
_NO_TERM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(text: str) -> np.ndarray:
    """Hashes of the distinct terms: runs of letters and digits in lower case, sorted."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    starts, ends, _ = spans_between(data, np.array([0, len(data)]), _NO_TERM)
    return np.unique(hash_spans(data, starts, ends))


def term_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of all documents, how many hold a term of each cell. The table has a fixed size whatever the corpus holds: terms are
    hashed into CELLS cells, so terms that share a cell count together. Summed by Spark, 4 MB in the end."""

    def run(batches):
        total, rows = np.zeros(CELLS, np.int32), 0
        for block in text_blocks(batches):
            for text in block.column("text").to_pylist():
                cells = np.unique(terms(text or "") & np.uint64(CELLS - 1)).astype(np.int64)
                total[cells] += 1
            rows += len(block)
        for part in range(0, CELLS, 1 << 14):
            found = np.flatnonzero(total[part:part + (1 << 14)]) + part
            yield pa.record_batch([pa.array(found), pa.array(total[found], pa.int64())], ["cell", "n"])
        yield pa.record_batch([pa.array([-1]), pa.array([rows])], ["cell", "n"])

    summed = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # rows of fixed width for the driver: chunks of a table whose size is set above
    chunk = F.floor(F.col("cell") / (1 << 14))
    chunks = summed.groupBy(chunk.alias("chunk")).agg(F.collect_list(F.struct("cell", "n")).alias("found"))
    packed = chunks.select(F.col("found.cell").alias("cell"), F.col("found.n").alias("n")).toArrow()
    cells = np.concatenate([np.zeros(0, np.int64), *(np.array(c) for c in packed.column("cell").to_pylist())])
    n = np.concatenate([np.zeros(0, np.int64), *(np.array(c) for c in packed.column("n").to_pylist())])
    out = np.zeros(CELLS, np.float32)
    out[cells[cells >= 0]] = n[cells >= 0]
    return out, int(n[cells < 0].sum())


def signature(text: str, in_band: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes by density: of each lexicon's terms in the text, 0 where it has none.

    A lexicon of density d holds a term with chance 2^-d. A text uses the two densities at which its lexicons hold at most about
    one term, so that a change of some terms leaves most lexicons as they were, whatever the length of the text.
    """
    found = terms(text)
    chosen = found[in_band[(found & np.uint64(CELLS - 1)).astype(np.int64)]]
    if len(chosen) < LEAST_TERMS:
        chosen = found
    if not len(chosen):
        whole = int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big") or 1
        return {-1: np.full(LEXICONS, whole, np.uint32)}
    out = {}
    level = int(np.log2(len(chosen)))
    salts = mix(np.arange(1, LEXICONS + 1, dtype=np.uint64) * _SPLIT)
    draws = mix(chosen[None, :] ^ salts[:, None])
    # the terms that the thinner lexicons hold are among those of the thicker
    lexicon, term = np.nonzero((draws >> np.uint64(63 - level)) == 0)
    held = draws[lexicon, term]
    for density in (level + 1, level + 2):
        inside = (held >> np.uint64(64 - density)) == 0
        owner, values = lexicon[inside], mix(held[inside])
        out[density] = np.zeros(LEXICONS, np.uint32)
        if len(owner):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            short = (np.add.reduceat(values, first) >> np.uint64(32)).astype(np.uint32)
            out[density][owner[first]] = np.maximum(short, 1)
    return out


def written(found: dict[int, np.ndarray]) -> str:
    """density:hashes in hex, for each density."""
    return ";".join(f"{d}:{h.astype('>u4').tobytes().hex()}" for d, h in sorted(found.items()))


def likeness(one: dict[int, np.ndarray], other: dict[int, np.ndarray]) -> float:
    """Dice's share: lexicons with equal hashes, of those that hold terms of a text, at the densities both texts use."""
    equal = used = 0
    for density in one.keys() & other.keys():
        used += int((one[density] > 0).sum() + (other[density] > 0).sum())
        equal += int(((one[density] > 0) & (one[density] == other[density])).sum())
    return 2 * equal / used if used else 0.0


def read(fingerprint: str) -> dict[int, np.ndarray]:
    return {int(d): np.frombuffer(bytes.fromhex(h), ">u4").astype(np.uint32)
            for d, h in (part.split(":") for part in fingerprint.split(";"))}


def band(docs: DataFrame, low: float = LOW_IDF, high: float = HIGH_IDF) -> np.ndarray:
    """Which cells lie in the band of inverse document frequency."""
    frequency, rows = term_frequencies(docs)
    idf = np.log(max(rows, 1) / np.maximum(frequency, 1))
    return (idf >= low) & (idf <= high)


def fingerprints(docs: DataFrame, in_band: np.ndarray) -> DataFrame:
    """doc_id, fingerprint of every row. Null counts as empty; equal texts have equal fingerprints."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(in_band))

    def run(batches):
        cells = np.unpackbits(shared.value).astype(bool)
        for block in text_blocks(batches):
            found = [written(signature(t or "", cells)) for t in block.column("text").to_pylist()]
            yield pa.record_batch([block.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, make, schema: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """make(doc_id, text, next text) for every row, in descending order of doc_id; after the last comes the first.

    Rows are sorted inside ranges of doc_id. The largest id of a range also goes to the range before it, to follow its last
    row. Null ids come last; rows of one id are in the order of their texts, descending; null texts are empty.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.select("doc_id").count()
    count = max(1, n // rows_per_range)
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile(
        "x", [k / count for k in range(1, count)], 0.2 / count))) if count > 1 else []
    if cuts:
        bucketizer = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="x", outputCol="place",
                                handleInvalid="keep")
        placed = bucketizer.transform(docs.withColumn("x", F.col("doc_id").cast("double")))
        docs = placed.select("doc_id", "text", (len(cuts) - F.col("place")).cast("int").alias("range"))
        docs = docs.withColumn("range", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.col("range")))
    else:
        docs = docs.withColumn("range", F.when(F.col("doc_id").isNull(), 1).otherwise(0))
    # one row per range: its first id
    tops = sorted(docs.groupBy("range").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        return docs.sparkSession.createDataFrame([], schema)
    # the first row of a range follows the last row of the range before; the first of all follows the last of all
    before = [(r["range"], r["top"], tops[k - 1]["range"]) for k, r in enumerate(tops)]
    edges = docs.sparkSession.createDataFrame(before, "edge_range int, top long, target int")
    first = docs.join(F.broadcast(edges), (F.col("range") == F.col("edge_range")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = first.groupBy("target").agg(F.max("text").alias("text"))
    rows = docs.select("range", F.lit(0).alias("late"), "doc_id", "text").unionByName(
        heads.select(F.col("target").alias("range"), F.lit(1).alias("late"), F.lit(None).cast("long").alias("doc_id"), "text"))
    rows = rows.repartition(len(tops), "range").sortWithinPartitions("range", "late", F.desc_nulls_last("doc_id"), F.desc("text"))

    def run(batches):
        last = None
        for block in text_blocks(batches):
            out = []
            for key, late, doc_id, text in zip(*(block.column(c).to_pylist() for c in ("range", "late", "doc_id", "text")),
                                               strict=True):
                if last is not None and last[0] == key:
                    out.append(make(last[1], last[2], text))
                last = None if late else (key, doc_id, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[p.split()[1]] for p in schema.split(", ")]
    names = [p.split()[0] for p in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def edited_fingerprints(docs: DataFrame, in_band: np.ndarray) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last third replaced by the beginning of the next document in descending order of doc_id (the
    first, after the last). A single document is its own next. Null and empty texts are empty, and like each other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(in_band))
    cells: list[np.ndarray] = []
    memo: dict[str, dict[int, np.ndarray]] = {}

    def make(doc_id, text, following):
        if not cells:
            cells.append(np.unpackbits(shared.value).astype(bool))
        # the next document is met again as the row that follows
        own = memo.get(text) or signature(text, cells[0])
        memo.clear()
        memo[following] = signature(following, cells[0])
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        changed = signature(edited, cells[0])
        return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(changed),
                likeness(own, changed), likeness(own, memo[following]))

    return with_next(docs, make, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                     "edited_fingerprint string, near_edited double, near_next double")
