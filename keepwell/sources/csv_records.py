"""CSV records that go over several lines, found across the splits of big files.

Whether a line starts inside quotes depends on all text before it, so a split cannot tell alone. But a split is a function
of two cases: where it ends, when it starts outside quotes, and when it starts inside. A first pass computes both for every
split; composing them along each file (one short row a split) gives every split its start. A second pass reads the lines
again, keeps the records that begin and end in the split, and hands on the pieces at its two ends, which are put together
by file. Only these pieces, at most two a split, are shuffled.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# tasks get this module's functions with the job, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 2_000  # records of one output batch


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether the text after a line is inside quotes. A quote opens only at the start of a value; two inside are one."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            close = line.find('"', at)
            if close < 0:
                return True
            if line.startswith('"', close + 1):
                at = close + 2
                continue
            inside, at = False, close + 1
        elif line.startswith('"', at) and (at == 0 or line[at - 1] == sep):
            inside, at = True, at + 1
            continue
        at = line.find(sep, at) + 1
        if not at:
            return False


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, line): `start` is where the line's split begins in its file; lines of a split are in order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"))


def needs_records(spark: SparkSession, path: str) -> bool:
    """Whether any line has an odd number of quotes, without which no value goes over a line. Stops at the first."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.option("lineSep", "\n").text(path).where(quotes % 2 == 1).isEmpty()


def _splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """The lines of the task, split by split."""
    def flat() -> Iterator[tuple[str, int, str]]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    rows = flat()
    row = next(rows, None)
    while row is not None:
        key = row[:2]

        def lines() -> Iterator[str]:
            nonlocal row
            while row is not None and row[:2] == key:
                line = row[2]
                row = next(rows, None)
                yield line

        found = lines()
        yield *key, found
        for _ in found:  # whatever the caller left
            pass


def openings(lines: DataFrame, sep: str) -> DataFrame:
    """(path, start) of the splits that start inside quotes: fewer rows than there are splits."""
    schema = "path string, start long, from_outside boolean, from_inside boolean"

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, split in _splits(batches):
            outside, inside = False, True
            for line in split:
                if '"' in line:
                    outside, inside = ends_inside(line, outside, sep), ends_inside(line, inside, sep)
            yield pa.RecordBatch.from_pydict(
                {"path": [path], "start": [start], "from_outside": [outside], "from_inside": [inside]})

    def composed(splits: pd.DataFrame) -> pd.DataFrame:
        now, found = False, []
        for split in splits.sort_values("start").itertuples():
            if now:
                found.append(split.start)
            now = bool(split.from_inside if now else split.from_outside)
        return pd.DataFrame({"path": pd.Series([splits["path"].iloc[0]] * len(found), dtype=object),
                             "start": pd.Series(found, dtype="int64")})

    return lines.mapInArrow(ends, schema).groupBy("path").applyInPandas(composed, "path string, start long")


def read_records(spark: SparkSession, path: str, width: int, sep: str = ",") -> DataFrame:
    """(cells array<string>, text): every record of the CSV files but their header rows; blank lines are none.

    `text` is the record as text where it does not have `width` values, else NULL. A file that ends inside quotes ends its
    last record there. A carriage return before the line feed that ends a record is dropped, and so is a byte order mark;
    line ends inside quotes stay as they are. Three scans of the files.
    """
    lines = lines_of(spark, path)
    opened = F.broadcast(openings(lines, sep).withColumn("inside", F.lit(True)))  # at most a short row for each split
    marked = lines.join(opened, ["path", "start"], "left").select(
        "path", "start", "line", F.coalesce("inside", F.lit(False)).alias("inside"))
    pieces = marked.mapInArrow(
        _pieces(sep), "path string, start long, place int, opens boolean, closes boolean, text string")
    whole = pieces.where("opens and closes").select("start", "place", "text")
    # a record in pieces is named by the split where it opens
    along = Window.partitionBy("path").orderBy("start", "place")
    broken = pieces.where("not (opens and closes)").withColumn(
        "home", F.last(F.when(F.col("opens"), F.struct("start", "place")), ignorenulls=True).over(along))
    in_order = F.array_sort(F.collect_list(F.struct("start", "place", "text")))
    joined = broken.groupBy("path", "home").agg(F.array_join(F.transform(in_order, lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(joined.select("home.start", "home.place", "text")).mapInArrow(
        _cells(sep, width), "cells array<string>, text string")


def _pieces(sep: str):
    """Runs of whole records as one text each, and the pieces of records at the ends of a split, in their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict[tuple, bool] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                starts.update(((path, start), inside) for path, start, inside in zip(
                    *(batch.column(c).to_pylist() for c in ("path", "start", "inside"))))
                yield batch.select(["path", "start", "line"])

        def piece(opens: bool, closes: bool, text: list[str]) -> pa.RecordBatch:
            nonlocal place
            place += 1
            return pa.RecordBatch.from_pydict(
                {"path": [path], "start": [start], "place": pa.array([place], pa.int32()), "opens": [opens],
                 "closes": [closes], "text": ["\n".join(text)]})

        for path, start, split in _splits(told()):
            place, inside = -1, starts[(path, start)]
            opens, waiting, done = not inside, [], []
            for line in split:
                waiting.append(line)
                inside = ends_inside(line, inside, sep)
                if inside:
                    continue
                if opens:
                    done += waiting
                else:  # the end of a record of an earlier split
                    yield piece(False, True, waiting)
                opens, waiting = True, []
                if len(done) >= BATCH:
                    yield piece(True, True, done)
                    done = []
            if done:
                yield piece(True, True, done)
            if waiting:
                yield piece(opens, False, waiting)

    return run


def _cells(sep: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        schema = pa.schema([("cells", pa.list_(pa.string())), ("text", pa.string())])
        for batch in batches:
            for start, place, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [r for r in csv.reader(_with_ends(text), delimiter=sep)
                        if r and not (len(r) == 1 and r[0].isspace())]
                if start == 0 and place == 0:
                    rows = rows[1:]  # the header
                yield pa.RecordBatch.from_pydict(
                    {"cells": rows, "text": [None if len(r) == width else sep.join(_spelled(v, sep) for v in r) for r in rows]},
                    schema=schema)

    return run


def _with_ends(text: str) -> Iterator[str]:
    """The lines with their line feeds, without the byte order mark of a file."""
    for line in text.removeprefix("\ufeff").split("\n"):
        yield line + "\n"


def _spelled(value: str, sep: str) -> str:
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in (sep, '"', "\n", "\r")) else value
