"""Operator 2: repeated byte strings by two-stage suffix sorting.

Every string of `length` bytes holds an anchor: its substring of GRAM bytes with the smallest hash. Equal strings have equal
anchors, so only strings under the same anchor can be equal. Spark first counts anchors; texts around anchors that occur more
than once, and not only in the same surroundings, are brought together and suffix-sorted: suffixes that are smaller than their
successor are sorted directly, all others are induced from their successors by scanning buckets; then common prefixes of
neighbours in the order show which strings repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.blobs import DECISIONS, blobs_of, by_part, identified, merged_documents, parts_for, spans_by_document, unpack, with_spans
from keepwell.llm.common import as_signed, flat, mix, stored, text_blocks
from keepwell.llm.recompression import Spelling

LENGTH, GRAM = 200, 32
_BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64))
_REFERENCES = ["<i8", "<i8", "?", "<u8", "<u8", "<i4", "<i4", "<i4"]
_FRAGMENTS = ["<i8", "<i8", "?", "<i4", "<i4", "<i4", "u1"]
_PLACE_BITS = np.uint64(28)


def anchor_rows(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of string starts with the same anchor: name of the anchor, hash of all the bytes of the run, text, start, count."""
    n = len(data) - length + 1
    if n <= 0:
        return None
    spelled = Spelling(_BYTE_NAMES[data])
    at = np.arange(len(data) - gram + 1)
    names = spelled.of(at, at + gram)
    if len(names) >= 1 << int(_PLACE_BITS):
        raise ValueError("a text of over 2^28 bytes")
    # the smallest hash in each string, the first of equal ones, by windows of doubling width
    least = (names & ~np.uint64((1 << int(_PLACE_BITS)) - 1)) | at.astype(np.uint64)
    span, width = 1, length - gram + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    place = (least[:n] & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    starts = np.flatnonzero(np.arange(n) + length <= offsets[1:][text])
    if not len(starts):
        return None
    new = np.concatenate(([True], (np.diff(place[starts]) != 0) | (np.diff(starts) != 1)))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    anchor = place[begin]
    content = spelled.of(begin, begin + count - 1 + length)
    return names[anchor], mix(content + (anchor - begin).astype(np.uint64)), text[begin], begin - offsets[:-1][text[begin]], count


def ids_of(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = block.column("doc_id")
    return column.fill_null(0).to_numpy(), block.column("version").to_numpy(), column.is_null().to_numpy(zero_copy_only=False)


def references(docs: DataFrame, parts: np.ndarray, length: int, gram: int) -> DataFrame:
    """(part, blob) rows: where each anchor is, and a hash of the bytes around it."""

    def run(batches):
        for block in text_blocks(batches):
            ids, versions, nulls = ids_of(block)
            found = anchor_rows(*flat(block.column("text")), length, gram)
            if found is None:
                continue
            key, content, text, begin, count = found
            yield from blobs_of(parts[key % np.uint64(len(parts))], lambda rows: [
                ids[used := np.unique(text[rows])], versions[used], nulls[used], key[rows], content[rows],
                np.searchsorted(used, text[rows]).astype(np.int32), begin[rows].astype(np.int32), count[rows].astype(np.int32)])

    return identified(docs).mapInArrow(run, "part long, blob binary")


def restore_nulls(batch: pa.RecordBatch, ids, versions, nulls) -> pa.RecordBatch:
    """Null ids travel as 0 beside a flag."""
    if not nulls.any():
        return batch
    hidden = set(versions[nulls].tolist()) - set(versions[~nulls & (ids == 0)].tolist())
    real = [None if i == 0 and v in hidden else i for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(real, pa.int64()), *batch.columns[1:]], batch.schema.names)


def sort_out(blobs: list[bytes], length: int, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of a part's anchors: spans that repeat in the same surroundings (decided: part, blob), and one fragment for each of
    several different surroundings of an anchor (to be suffix-sorted: doc_id, version, starts, ends, keys)."""
    tables = [unpack(b, _REFERENCES) for b in blobs]
    ids, versions, nulls, rank = merged_documents(tables)
    base = np.cumsum([0, *(len(t[0]) for t in tables)])[:-1]
    key, content, begin, count = (np.concatenate([t[k] for t in tables]) for k in (3, 4, 6, 7))
    doc = np.concatenate([rank[t[5] + b] for t, b in zip(tables, base, strict=True)])
    by = np.lexsort((begin, doc, content, key))
    k, c = key[by], content[by]
    first_key = np.concatenate(([True], k[1:] != k[:-1]))
    first = first_key | np.concatenate(([True], c[1:] != c[:-1]))
    group = np.cumsum(first_key) - 1
    variants = np.bincount(group[first], minlength=group[-1] + 1)[group]
    copies = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1]
    asked_for = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("starts", ints := pa.list_(pa.int32())), ("ends", ints),
                           ("keys", pa.list_(pa.int64()))])
    span = begin[by].astype(np.int64)
    until = span + count[by] - 1 + length
    repeated = copies > 1
    for batch in spans_by_document(doc[by][repeated], span[repeated], until[repeated], ids, nulls, versions, parts):
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(len(batch), f.type) for f in asked_for)],
                                         ["part", "blob", *asked_for.names])
    asked = np.flatnonzero(first & (variants > 1))
    if len(asked):
        asked = asked[np.lexsort((span[asked], doc[by][asked]))]
        owner = doc[by][asked]
        new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        cuts = pa.array(np.append(new, len(owner)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (
            span[asked].astype(np.int32), until[asked].astype(np.int32), as_signed(k[asked]))]
        batch = pa.RecordBatch.from_arrays([pa.array(ids[owner[new]]), pa.array(versions[owner[new]]), *lists], asked_for.names)
        batch = restore_nulls(batch, ids, versions, nulls)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), pa.nulls(len(batch), pa.binary()), *batch.columns],
                                         ["part", "blob", *asked_for.names])


def fragments(docs: DataFrame, asked: DataFrame, parts: np.ndarray) -> DataFrame:
    """(part, blob) rows: the asked-for fragments of texts, by anchor."""
    wanted = asked.groupBy("doc_id", "version").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "keys")))
    rows = identified(docs).alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
                                            & (F.col("d.version") == F.col("w.version"))).select("d.*", "starts", "ends", "keys")

    def run(batches):
        for block in text_blocks(batches):
            ids, versions, nulls = ids_of(block)
            data, offsets = flat(block.column("text"))
            starts, ends, keys = (block.column(c).flatten().to_numpy() for c in ("starts", "ends", "keys"))
            text = np.repeat(np.arange(len(ids)), [len(x) for x in block.column("starts")])
            if not len(text):
                continue
            part = parts[keys.view(np.uint64) % np.uint64(len(parts))]

            def make(rows):
                used = np.unique(text[rows])
                size = (ends[rows] - starts[rows]).astype(np.int64)
                first = np.cumsum(size) - size
                source = np.repeat(offsets[:-1][text[rows]] + starts[rows] - first, size) + np.arange(size.sum())
                return [ids[used], versions[used], nulls[used], np.searchsorted(used, text[rows]).astype(np.int32), starts[rows],
                        ends[rows], data[source]]

            yield from blobs_of(part, make)

    return rows.mapInArrow(run, "part long, blob binary")


def sort_directly(chunks: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """The suffixes in the order of their first `length` bytes, eight at a time; only ties are sorted further."""
    rows = rows[np.argsort(chunks[rows], kind="stable")]
    tied = np.arange(len(rows))
    value = chunks[rows]
    group = np.cumsum(np.concatenate(([True], value[1:] != value[:-1]))) - 1 if len(rows) else tied
    for depth in range(8, length, 8):
        # places whose group has more than one suffix
        sizes = np.bincount(group)
        several = sizes[group] > 1
        tied, group = tied[several], group[several]
        if not len(tied):
            break
        at = rows[tied]
        value = chunks[at + depth]
        by = np.lexsort((value, group))
        rows[tied] = at[by]
        value, group = value[by], group[by]
        group = np.cumsum(np.concatenate(([True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])))) - 1
    return rows


def suffix_order(data: np.ndarray, chunks: np.ndarray, owned: np.ndarray, length: int) -> np.ndarray:
    """The owned suffixes in order. A suffix whose first byte is larger than its second follows from its successor."""
    falls = np.append(data[:-1] > data[1:], False)
    # a successor that is not owned takes part as well; that its last bytes are another text's can't part what is equal before
    used, edge = owned.copy(), np.flatnonzero(owned & falls)
    while len(edge):
        edge = edge[~used[edge + 1]] + 1
        used[edge] = True
        edge = edge[falls[edge]]
    induced = used & falls
    direct = sort_directly(chunks, np.flatnonzero(used & ~induced), length)
    heads = data[direct]
    cuts = np.searchsorted(heads, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        # in a bucket those with a smaller second byte come first; all their successors stand in earlier buckets
        bucket = np.concatenate([*pending[byte], direct[cuts[byte]:cuts[byte + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before]]
        if len(before):
            head = data[before]
            by = np.argsort(head, kind="stable")
            before, head = before[by], head[by]
            edge = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1], [True])))
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                pending[head[s]].append(before[s:e])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[owned[order]]


def repeated_starts(order: np.ndarray, chunks: np.ndarray, length: int) -> np.ndarray:
    """The suffixes that share at least `length` bytes with a neighbour in the order."""
    one, other = order[:-1], order[1:]
    for depth in [*range(0, length - 8, 8), length - 8]:
        same = chunks[one + depth] == chunks[other + depth]
        one, other = one[same], other[same]
        if not len(one):
            break
    return np.union1d(one, other)


def suffix_sort(blobs: list[bytes], length: int, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The repeated spans among the fragments of a part."""
    tables = [unpack(b, _FRAGMENTS) for b in blobs]
    ids, versions, nulls, rank = merged_documents(tables)
    base = np.cumsum([0, *(len(t[0]) for t in tables)])[:-1]
    doc = np.concatenate([rank[t[3] + b] for t, b in zip(tables, base, strict=True)])
    start, end = (np.concatenate([t[k] for t in tables]).astype(np.int64) for k in (4, 5))
    data = np.concatenate([t[6] for t in tables])
    size = end - start
    first = np.cumsum(size) - size
    fragment = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(data)) - first[fragment]
    owned = inside <= size[fragment] - length
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8)))
    chunks = np.zeros(len(data) + length, np.uint64)
    for k in range(8):
        chunks = (chunks << np.uint64(8)) | padded[k:k + len(chunks)]
    found = repeated_starts(suffix_order(data, chunks, owned, length), chunks, length)
    place = start[fragment[found]] + inside[found]
    yield from spans_by_document(doc[fragment[found]], place, place + length, ids, nulls, versions, parts)


def repeated_strings(docs: DataFrame, parts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """DECISIONS: bytes covered by a string of `length` bytes that also starts elsewhere."""
    found = stored(by_part(references(docs, parts, length, gram), parts, lambda blobs: sort_out(blobs, length, parts),
                           f"{DECISIONS}, doc_id long, version long, starts array<int>, ends array<int>, keys array<long>"), "anchors")
    asked = found.where("keys is not null").drop("part", "blob")
    sorted_out = by_part(fragments(docs, asked, parts), parts, lambda blobs: suffix_sort(blobs, length, parts), DECISIONS)
    return found.where("keys is null").select("part", "blob").unionByName(sorted_out)


def dedup_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256 of every row; all copies of a string are removed.

    Texts are UTF-8 bytes; null and empty ones have none, and texts shorter than `length` repeat nothing. Rows equal in id and
    text are copies of each other. Other columns are ignored. Reads `docs` three times.
    """
    parts = parts_for(docs)
    joined = with_spans(docs, repeated_strings(docs, parts, length, gram), parts)

    def run(batches):
        for block in text_blocks(batches):
            out = []
            for text, starts, ends in zip(*(block.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True):
                data = (text or "").encode()
                spans, kept = [], data
                for s, e in sorted(zip(starts or [], ends or [], strict=True)):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                if spans:
                    edges = [0, *(x for span in spans for x in span), len(data)]
                    kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.record_batch([block.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))],
                                  ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
