"""Shared pieces of the text operators: tables, Arrow blocks, and vectorised hashing of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from keepwell.session import new_path

BLOCK_BYTES = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTE_CODES = np.random.RandomState(20240607).randint(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64)]
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows. From now on the session hands them to Python in small Arrow batches, as texts may be long: a task holds
    each batch several times, in the JVM's buffers and in Python."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, in small Arrow batches."""
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: the lineage ends here and lost executors cost no rerun."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_blocks(batches: Iterable[pa.RecordBatch], column: str | int = "text",
                limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts stay under `limit` bytes together; a longer text is alone in its slice."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for row, size in enumerate(sizes):
            if row > start and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the offsets of the texts in it. Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def powers(n: int) -> np.ndarray:
    """At least n powers of the hash base, modulo 2^64."""
    if len(_POWERS[0]) < n:
        steps = np.full(max(n, 2 * len(_POWERS[0])), BASE)
        steps[0] = 1
        _POWERS[0] = np.multiply.accumulate(steps)
    return _POWERS[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span; spans are in order and don't overlap. An empty span hashes to mix(0)."""
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint64)
    filled = np.flatnonzero(sizes > 0)
    if len(filled):
        s, n = starts[filled], sizes[filled]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        codes = _BYTE_CODES[data[np.repeat(s, n) + place]]
        out[filled] = np.add.reduceat(codes * powers(int(n.max()))[place], first) + n.astype(np.uint64) * _MIX
    return mix(out)


def spans_between(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans of non-separator bytes that stay inside a text: starts, ends, and the text of each."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space: starts, ends, hashes, and for each text the place of its first word (one more at the end)."""
    starts, ends, _ = spans_between(data, offsets, SEPARATORS)
    return starts, ends, hash_spans(data, starts, ends), np.searchsorted(starts, offsets, "left")


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * BASE + values[k:k + n]
    return mix(total)


def as_signed(values: np.ndarray) -> np.ndarray:
    """The same bits as signed 64-bit integers, as Spark's long."""
    return np.ascontiguousarray(values).view(np.int64)
