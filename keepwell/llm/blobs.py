"""Numpy arrays as packed binary rows: many small records share one row on their way through a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import BASE, mix

DECISIONS = "part long, blob binary"
PART_BYTES = 24_000_000
_SPANS = ["<i8", "?", "<i8", "<i4", "<i4", "<i4"]


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of set types, one after the other, each with its length in bytes."""
    return b"".join(len(data := np.ascontiguousarray(a).tobytes()).to_bytes(8, "little") + data for a in arrays)


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(blob[at:at + 8], "little")
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def parts_for(docs: DataFrame, bytes_each: int = PART_BYTES) -> np.ndarray:
    """Labels of so many parts that each stands for about `bytes_each` of text, and no fewer than the session's shuffle has.

    The labels are numbers that Spark's hash deals to different partitions, so that each task gets one part.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_each))
    found = spark.range(40 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("at")).agg(F.min("id").alias("id")).collect()
    return np.array([r["id"] for r in found], np.int64)


def by_part(rows: DataFrame, parts: np.ndarray, solve, schema: str) -> DataFrame:
    """solve(blobs of a part) for each part of (part, blob); yields record batches. A task holds one part at a time."""

    def run(batches):
        part, held = None, []
        for batch in batches:
            for number, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if number != part and held:
                    yield from solve(held)
                    held = []
                part = number
                held.append(blob)
        if held:
            yield from solve(held)

    return rows.repartition(len(parts), "part").sortWithinPartitions("part").mapInArrow(run, schema)


def blobs_of(part: np.ndarray, make) -> Iterator[pa.RecordBatch]:
    """One (part, blob) row for the rows of each part."""
    by = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(part[by]) != 0, [True])))
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        yield pa.record_batch([pa.array([int(part[by[s]])], pa.int64()), pa.array([pack(make(by[s:e]))], pa.binary())], ["part", "blob"])


def united(rank: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the spans of each document, by document and start."""
    by = np.lexsort((starts, rank))
    rank, starts, ends = rank[by].astype(np.int64), starts[by].astype(np.int64), ends[by].astype(np.int64)
    # ends never fall along a document once running maxima are taken; documents are set far apart
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(ends + rank * far)
    at = np.flatnonzero(np.concatenate(([True], starts[1:] + rank[1:] * far > reach[:-1])))
    last = np.concatenate((at[1:] - 1, [len(rank) - 1]))
    return rank[at], starts[at], reach[last] - rank[last] * far


def spans_by_document(rank: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, nulls: np.ndarray,
                      versions: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """DECISIONS rows: spans of documents (places in ids, nulls and versions), one row for all documents of a part.

    Spans of a document are decided in many parts, the more the more parts there are, so a row for each document and part
    would be many times the documents.
    """
    if not len(rank):
        return
    rank, starts, ends = united(rank, starts, ends)
    part = parts[mix(ids.astype(np.uint64) * BASE + versions.astype(np.uint64)) % np.uint64(len(parts))]

    def make(rows):
        used, local = np.unique(rank[rows], return_inverse=True)
        return [ids[used], nulls[used], versions[used], local.astype(np.int32), starts[rows].astype(np.int32), ends[rows].astype(np.int32)]

    yield from blobs_of(part[rank], make)


def merged_documents(tables: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents (id, version, null flag) of all tables once, and for each entry of each table its place among them."""
    ids, versions, nulls = (np.concatenate([t[k] for t in tables]) for k in range(3))
    by = np.lexsort((nulls, versions, ids))
    i, v, z = ids[by], versions[by], nulls[by]
    new = np.concatenate(([True], (i[1:] != i[:-1]) | (v[1:] != v[:-1]) | (z[1:] != z[:-1])))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new) - 1
    return i[new], v[new], z[new], rank


def merged_spans(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """doc_id, version, starts, ends: one row for each document of a part, with the union of its spans."""
    tables = [unpack(b, _SPANS) for b in blobs]
    ids, versions, nulls, place = merged_documents([[t[0], t[2], t[1]] for t in tables])
    base = np.cumsum([0, *(len(t[0]) for t in tables)])[:-1]
    rank, starts, ends = united(*(np.concatenate(x) for x in zip(*(
        (place[t[3] + b], t[4], t[5]) for t, b in zip(tables, base, strict=True)), strict=True)))
    new = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
    offsets, docs = pa.array(np.append(new, len(rank)).astype(np.int32)), rank[new]
    yield pa.RecordBatch.from_arrays([
        pa.array(ids[docs], mask=nulls[docs]), pa.array(versions[docs]),
        pa.ListArray.from_arrays(offsets, pa.array(starts.astype(np.int32))),
        pa.ListArray.from_arrays(offsets, pa.array(ends.astype(np.int32)))], ["doc_id", "version", "starts", "ends"])


def with_spans(docs: DataFrame, decisions: DataFrame, parts: np.ndarray) -> DataFrame:
    """doc_id, text, starts, ends: every row with the union of all spans decided for it."""
    merged = by_part(decisions, parts, merged_spans, "doc_id long, version long, starts array<int>, ends array<int>")
    rows = identified(docs).alias("d").join(merged.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))
                                            & (F.col("d.version") == F.col("m.version")), "left")
    return rows.select("d.doc_id", "text", "starts", "ends")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text), text of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


def covered(size: int, starts, ends) -> np.ndarray:
    """Which of `size` places lie in a span."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, np.asarray(starts, np.int64), 1)
    np.add.at(edges, np.asarray(ends, np.int64), -1)
    return np.cumsum(edges[:-1]) > 0


def document_order(ids: np.ndarray, nulls: np.ndarray, versions: np.ndarray) -> np.ndarray:
    """Rows by id, null ids first, then by version."""
    return np.lexsort((versions, ids, ~nulls))
