"""Operator 3: line dedup by patience alignment with the documents that first held a line."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import BASE, hash_spans, mix, stored, text_blocks

#: An aligned block is deleted if it has at least so many words.
LEAST_WORDS = 5
KEY = "key struct<doc_id:bigint,version:bigint>"


def with_key(docs: DataFrame) -> DataFrame:
    """The rows with `key`: id and a hash of the text. Structs compare nulls as equal, so null ids are keys, too."""
    return docs.withColumn("key", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version")))


def split_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def line_codes(lines: list[str]) -> list[int]:
    """A hash of each line without surrounding blanks; 0 for a blank line."""
    parts = [line.strip().encode() for line in lines]
    ends = np.cumsum([len(p) for p in parts])
    found = hash_spans(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends).view(np.int64)
    return [int(h) if p else 0 for h, p in zip(found, parts, strict=True)]


def lengths(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of `one` and each beginning of `other`, the empty one first."""
    row = np.zeros(len(other) + 1, np.int64)
    for code in one:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (other == code)))
    return row


def common(one: list[int], other: list[int]) -> list[tuple[int, int]]:
    """Aligned pairs of a longest common subsequence, by halves of `one` (Hirschberg), so in linear space."""
    both = set(one) & set(other)
    (at, a), (bt, b) = (([k for k, c in enumerate(x) if c in both], np.array([c for c in x if c in both], np.int64)) for x in (one, other))
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((at[a0], bt[b0]))
            a0, b0 = a0 + 1, b0 + 1
        if a1 - a0 == 1:
            found = np.flatnonzero(b[b0:b1] == a[a0])
            out += [(at[a0], bt[b0 + int(found[0])])] if len(found) else []
        elif a0 < a1 and b0 < b1:
            half = (a0 + a1) // 2
            split = b0 + int((lengths(a[a0:half], b[b0:b1]) + lengths(a[half:a1][::-1], b[b0:b1][::-1])[::-1]).argmax())
            todo += [(a0, half, b0, split), (half, a1, split, b1)]
    return sorted(out)


def patience(one: list[int], other: list[int]) -> list[tuple[int, int]]:
    """Aligned pairs of equal lines, in order in both: lines that are unique in both anchor the alignment (longest
    increasing subsequence), equal neighbours extend it, and the gaps between are aligned in the same way; a gap without such
    lines is aligned by a longest common subsequence."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(one), 0, len(other))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and one[a0] == other[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and one[a1 - 1] == other[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        place: dict[int, int] = {}
        for j in range(b0, b1):
            place[other[j]] = -1 if other[j] in place else j
        seen: dict[int, int] = {}
        for i in range(a0, a1):
            seen[one[i]] = -1 if one[i] in seen else i
        shared = [(i, place[code]) for code, i in seen.items() if code and i >= 0 and place.get(code, -1) >= 0]
        if not shared:
            if any(code and code in place for code in seen):
                matched += [(a0 + i, b0 + j) for i, j in common(one[a0:a1], other[b0:b1])]
            continue
        ends: list[int] = []
        best: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(shared):
            at = bisect_left(ends, j)
            back.append(best[at - 1] if at else -1)
            ends[at:at + 1], best[at:at + 1] = [j], [k]
        chain, k = [], best[-1]
        while k >= 0:
            chain.append(shared[k])
            k = back[k]
        for i, j in chain:  # from the last to the first; what lies right of an anchor starts with it
            todo.append((i, a1, j, b1))
            a1, b1 = i, j
        todo.append((a0, a1, b0, b1))
    return sorted(matched)


def repeated(earlier: list[int], later: list[int], sizes: list[int], least_words: int) -> list[int]:
    """The lines of the later document in aligned common blocks with enough words. Blank lines go with the block they end."""
    out: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in block) >= least_words:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def runs(codes: list[int], sizes: list[int], least_words: int) -> list[int]:
    """Codes by which a document is linked: its lines, neighbouring lines that are not blank, and from and up to each line
    the shortest run of lines with enough words. Each line of a block that may be deleted is in such a run inside the block."""
    filled = [k for k, code in enumerate(codes) if code]
    spans = {(a, b + 1) for a, b in zip(filled, filled[1:])}
    start = words = 0
    for end in filled:
        words += sizes[end]
        while words - sizes[start] >= least_words:
            words -= sizes[start]
            start += 1
        if words >= least_words:
            spans.add((start, end + 1))  # the last start for this end
    end = len(codes)
    words = 0
    for start in reversed(filled):
        words += sizes[start]
        while words - sizes[end - 1] >= least_words:
            end -= 1
            words -= sizes[end]
        if words >= least_words:
            spans.add((start, end))
    values = np.array(codes, np.int64).view(np.uint64)
    by_size: dict[int, list[int]] = {}
    for a, b in spans:
        if b - a > 1:
            by_size.setdefault(b - a, []).append(a)
    found = {code for code in codes if code}
    for size, at in by_size.items():
        total = np.full(len(at), size, np.uint64)
        for k in range(size):
            total = mix(total * BASE + values[np.array(at) + k])
        found.update(map(int, total.view(np.int64)))
    return list(found)


def line_table(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """key, lines array<long>, sizes array<int> (words), runs array<long> of every row."""

    def run(batches):
        for block in text_blocks(batches):
            lines = [split_lines(t) for t in block.column("text").to_pylist()]
            codes, sizes = [line_codes(x) for x in lines], [[len(line.split()) for line in x] for x in lines]
            linked = [runs(c, n, least_words) for c, n in zip(codes, sizes, strict=True)]
            yield pa.record_batch([
                block.column("key"), pa.array(codes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())),
                pa.array(linked, pa.list_(pa.int64()))], ["key", "lines", "sizes", "runs"])

    return with_key(docs).select("key", "text").mapInArrow(run, f"{KEY}, lines array<long>, sizes array<int>, runs array<long>")


def deletions(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """key, removed array<int>: the lines to delete of each document that has any.

    A line or run of lines (`runs`) held by several documents links each later one to the first that holds it; the two are
    aligned. So every block of a document that any earlier one holds is looked at, however frequent it is, and no document
    is paired with more others than four times its lines.
    """
    table = stored(line_table(docs, least_words), "lines").dropDuplicates(["key"])
    held = table.select("key", F.explode("runs").alias("line"))
    table = table.drop("runs")
    first = held.groupBy("line").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = held.join(first, "line").where("key <> first").select("first", "key").distinct()
    early = table.select(F.col("key").alias("first"), F.col("lines").alias("early"))
    both = pairs.join(early, "first").join(table, "key").select("key", "early", "lines", "sizes")

    def run(batches):
        for batch in batches:
            found = [repeated(*row, least_words) for row in zip(*(batch.column(c).to_pylist() for c in ("early", "lines", "sizes")),
                                                                strict=True)]
            yield pa.record_batch([batch.column("key"), pa.array(found, pa.list_(pa.int32()))], ["key", "removed"])

    removed = both.mapInArrow(run, f"{KEY}, removed array<int>")
    return removed.where("size(removed) > 0").groupBy("key").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept string, kept_sha256 of every row.

    A null text has no lines and stays null; an empty one has one blank line. Blank lines alone are never repeats. Rows equal
    in id and text are one document and get the same result; rows of one id and different texts are compared by a hash of
    the text. The earlier document is that of the smaller id (null ids first). Other columns are ignored. Reads `docs` twice.
    """
    joined = with_key(docs).select("key", "text").join(deletions(docs, least_words), "key", "left").select(
        F.col("key.doc_id").alias("doc_id"), "text", "removed")

    def run(batches):
        for block in text_blocks(batches):
            out = []
            for text, gone in zip(block.column("text").to_pylist(), block.column("removed").to_pylist(), strict=True):
                kept, n = without(text, gone)
                out.append((n, len(gone or ()), kept, hashlib.sha256((kept or "").encode()).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([block.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))],
                                  ["doc_id", "n_lines", "n_removed", "kept", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept string, kept_sha256 string")


def without(text: str | None, removed: list[int] | None) -> tuple[str | None, int]:
    """The text without the lines, and how many it had. A text that loses nothing stays as it is."""
    if text is None:
        return None, 0
    lines = split_lines(text)
    if not removed:
        return text, len(lines)
    gone = set(removed)
    return "\n".join(line for k, line in enumerate(lines) if k not in gone), len(lines)


def dedup_documents(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows with repeated lines deleted and the same columns. A document of which nothing but blanks is left is dropped;
    one that loses nothing stays, whatever it holds."""
    schema, names = docs.schema, docs.columns
    rows = with_key(docs.select(F.struct(*names).alias("row"), "doc_id", "text")).select("row", "key")  # the text travels once
    joined = rows.join(deletions(docs, least_words), "key", "left").select("row", "removed")
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        wide = (pa.RecordBatch.from_arrays([*b.column("row").flatten(), b.column("removed")], [*names, "removed"]) for b in batches)
        for block in text_blocks(wide, at):
            *columns, removed = block.columns
            texts, gone = columns[at].to_pylist(), removed.to_pylist()
            kept = [without(t, g)[0] for t, g in zip(texts, gone, strict=True)]
            columns[at] = pa.array(kept, pa.string())
            if size is not None:
                columns[size] = pa.array([None if t is None else len(t) for t in kept], columns[size].type)
            some = [not g or bool(t.strip()) for t, g in zip(kept, gone, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(some))

    return joined.mapInArrow(run, schema)
