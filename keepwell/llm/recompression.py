"""Operator 4: repeated passages of words by recompression.

Rounds name runs of equal symbols and then pairs of neighbours, as long as a symbol stays short. A name is a hash of what
the symbol spells, so equal passages get equal names in every task and every document, without a table of names. For each
boundary between symbols it is known which words decided it; a window of words that holds all of these has the boundary
wherever it stands. Each window is filed under one such boundary, its anchor, and only windows under equal anchors can be
equal: Spark brings the anchors of a name together, where windows are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keepwell.llm.blobs import DECISIONS, by_part, covered, document_order, identified, pack, parts_for, spans_by_document, unpack, with_spans
from keepwell.llm.common import BASE, flat, mix, powers, text_blocks, window_hashes, words

#: Words of a window, rounds of naming, and the most words of a named symbol.
WINDOW, ROUNDS, LONGEST = 20, 2, 6
_KINDS = ["<i8", "?", "<i8", "<u8", "<i4", "<i4", "u1", "<u4", "u1", "<i4", "<i4", "<i4"]
_INVERSE = [np.ones(1, np.uint64)]


def inverse_powers(n: int) -> np.ndarray:
    if len(_INVERSE[0]) < n:
        steps = np.full(max(n, 2 * len(_INVERSE[0])), np.uint64(pow(int(BASE), -1, 2**64)))
        steps[0] = 1
        _INVERSE[0] = np.multiply.accumulate(steps)
    return _INVERSE[0]


class Spelling:
    """Hashes of any span of a sequence by what it spells."""

    def __init__(self, values: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers(len(values) + 1)[:len(values)], dtype=np.uint64)))
        self.inverse = inverse_powers(len(values) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def boundaries(values: np.ndarray, rounds: int = ROUNDS, longest: int = LONGEST) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each round (first: the words themselves) the boundaries between symbols and the span of words that decides each:
    positions, first word, end of the last word. Boundaries near the ends of the sequence have spans beyond it."""
    n, spelled = len(values), Spelling(values)
    at = np.arange(n + 1)
    low, high = at.copy(), at.copy()
    low[0], high[-1] = -(1 << 30), 1 << 30
    out = [(at, low, high)]

    def around(low, high, left, right):
        """The span over the boundaries `left` before to `right` after each."""
        m = len(low)
        a, b = low.copy(), high.copy()
        for k in range(1, int(max(left.max(initial=0), right.max(initial=0))) + 1):
            back = np.flatnonzero(left >= k)
            a[back] = np.minimum(a[back], low[np.maximum(back - k, 0)])
            b[back] = np.maximum(b[back], high[np.maximum(back - k, 0)])
            ahead = np.flatnonzero(right >= k)
            a[ahead] = np.minimum(a[ahead], low[np.minimum(ahead + k, m - 1)])
            b[ahead] = np.maximum(b[ahead], high[np.minimum(ahead + k, m - 1)])
        return a, b

    for turn in range(rounds):
        # runs: equal neighbours become one symbol, if the whole run is short enough
        size = np.diff(at)
        names = spelled.of(at[:-1], at[1:])
        equal = np.zeros(len(at), bool)
        equal[1:-1] = names[1:] == names[:-1]
        run = np.flatnonzero(~equal[:-1])
        index = np.cumsum(~equal[:-1]) - 1
        count = np.diff(np.append(run, len(names)))
        short = count * size[run] <= longest
        inside = np.zeros(len(at), bool)
        inside[:-1] = equal[:-1] & short[index]
        left, right = np.ones(len(at), np.int64), np.ones(len(at), np.int64)
        long_run = np.flatnonzero(equal & ~inside)
        if len(long_run):
            # a boundary inside a long run is decided by enough equal symbols, or by those up to the first other one
            i = index[long_run]
            enough = longest // size[long_run] + 1
            left[long_run] = np.minimum(long_run - run[i] + 1, enough)
            right[long_run] = np.minimum(run[i] + count[i] - long_run + 1, enough)
        low, high = around(low, high, left, right)
        keep = ~inside
        at, low, high = at[keep], low[keep], high[keep]
        # pairs: symbols fall into two sides by their names; one of the first and one of the second become a symbol
        names = spelled.of(at[:-1], at[1:])
        size = np.diff(at)
        side = (mix(names + np.uint64(turn + 1)) >> np.uint64(63)) == 1
        joined = np.zeros(len(at), bool)
        joined[1:-1] = ~side[:-1] & side[1:] & (size[:-1] + size[1:] <= longest)
        one = np.ones(len(at), np.int64)
        low, high = around(low, high, one, one)
        keep = ~joined
        at, low, high = at[keep], low[keep], high[keep]
        out.append((at, low, high))
    return out


def anchors(values: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For windows at `starts`: a name of the anchor with what decides it, and the anchor's place in the sequence.

    The anchor is a boundary of the highest round that has one decided inside the window; of several the one whose deciding
    words have the smallest hash, then the first.
    """
    name, place = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    todo, spelled, n = np.arange(len(starts)), Spelling(values), len(values)
    for level, (at, low, high) in reversed(list(enumerate(boundaries(values)))):
        if not len(todo):
            break
        good = (low >= 0) & (high <= n)
        begin, end = np.full(n + window + 2, -1, np.int64), np.full(n + window + 2, 1 << 40, np.int64)
        order = np.full(n + window + 2, np.uint64(2**64 - 1))
        begin[at[good]], end[at[good]] = low[good], high[good]
        order[at[good]] = spelled.of(low[good], np.maximum(high[good], low[good])) if level else values[np.minimum(at[good], n - 1)]
        p = starts[todo]
        best, where = np.full(len(p), np.uint64(2**64 - 1)), np.full(len(p), -1, np.int64)
        for d in range(window + (level > 0)):
            x = p + d
            o = order[x]
            better = (begin[x] >= p) & (end[x] <= p + window) & (o < best)
            best = np.where(better, o, best)
            where = np.where(better, x, where)
        found = where >= 0
        row = where[found]
        # the name tells the round, the deciding words, and where in them the boundary is
        name[todo[found]] = mix(best[found] + np.uint64(level * 977) + (row - begin[row]).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        place[todo[found]] = row
        todo = todo[~found]
    return name, place


def anchored(docs: DataFrame, parts: np.ndarray, window: int = WINDOW) -> DataFrame:
    """(part, blob) rows: windows filed under anchors. Windows repeated inside a block of documents are decided at once and
    only travel as spans, so a passage that many documents share leaves a task once."""

    def run(batches):
        for block in text_blocks(batches):
            nulls = block.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = block.column("doc_id").fill_null(0).to_numpy()
            versions = block.column("version").to_numpy()
            by = document_order(ids, nulls, versions)
            # rows equal in id and text are one document
            same = (np.diff(ids[by]) == 0) & (np.diff(versions[by]) == 0) & (nulls[by][1:] == nulls[by][:-1])
            by = by[np.concatenate(([True], ~same))]
            ids, nulls, versions = ids[by], nulls[by], versions[by]
            data, offsets = flat(block.column("text").take(pa.array(by)))
            _, _, values, first = words(data, offsets)
            # one sequence with a separate word between documents
            counts = np.diff(first)
            doc = np.repeat(np.arange(len(counts)), counts + 1)
            begin = np.cumsum(counts + 1) - (counts + 1)
            line = mix(np.arange(len(doc), dtype=np.uint64) + np.uint64(1 << 60))
            line[np.arange(len(values)) + np.repeat(np.arange(len(counts)), counts)] = values
            starts = np.flatnonzero(np.arange(len(doc)) + window <= (begin + counts)[doc])
            if not len(starts):
                continue
            content = window_hashes(line, window)[starts]
            order = np.argsort(content, kind="stable")
            again = np.zeros(len(starts), bool)
            again[order[1:]] = content[order[1:]] == content[order[:-1]]
            seen, fresh = starts[again], ~again
            starts, content = starts[fresh], content[fresh]
            name, place = anchors(line, starts, window)
            new = np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (name[1:] != name[:-1])))
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(starts)))
            key, row_doc = name[at], doc[starts[at]]
            part = parts[key % np.uint64(len(parts))]
            where = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(part[where]) != 0, [True])))
            decided = (doc[seen], seen - begin[doc[seen]])
            for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                rows = where[s:e]
                inner = np.repeat(at[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows]) + np.arange(size[rows].sum())
                used, local = np.unique(row_doc[rows], return_inverse=True)
                extra_doc, extra = (decided if k == 0 else (decided[0][:0], decided[1][:0]))
                if len(extra_doc):
                    used = np.union1d(used, extra_doc)
                    local = np.searchsorted(used, row_doc[rows])
                # windows that follow each other are one span
                cut = np.flatnonzero(np.concatenate(([True], (np.diff(extra) != 1) | (np.diff(extra_doc) != 0)))) if len(extra) else extra
                till = extra[np.append(cut[1:] - 1, len(extra) - 1)] + window if len(extra) else extra
                short = content[inner]
                yield pa.record_batch([pa.array([part[rows[0]]]), pa.array([pack([
                    ids[used], nulls[used], versions[used], key[rows], local.astype(np.int32),
                    (starts[at[rows]] - begin[row_doc[rows]]).astype(np.int32), size[rows].astype(np.uint8),
                    (short >> np.uint64(32)).astype(np.uint32), ((short >> np.uint64(24)) & np.uint64(255)).astype(np.uint8),
                    np.searchsorted(used, extra_doc[cut]).astype(np.int32), extra[cut].astype(np.int32), till.astype(np.int32)])],
                    pa.binary())], ["part", "blob"])

    return identified(docs).mapInArrow(run, "part long, blob binary")


def later_windows(blobs: list[bytes], parts: np.ndarray, window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """The spans covered by windows that also start earlier, among the windows of a part."""
    tables = [unpack(b, _KINDS) for b in blobs]
    sizes = np.array([len(t[0]) for t in tables])
    ids, nulls, versions = (np.concatenate([t[k] for t in tables]) for k in range(3))
    by = document_order(ids, nulls, versions)
    rank_of = np.empty(len(by), np.int64)
    ids, nulls, versions = ids[by], nulls[by], versions[by]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1]) | (nulls[1:] != nulls[:-1])))
    rank_of[by] = np.cumsum(new) - 1
    ids, nulls, versions = ids[new], nulls[new], versions[new]
    base = np.cumsum(sizes) - sizes
    doc = np.concatenate([rank_of[t[4] + b] for t, b in zip(tables, base, strict=True)])
    key, start, count, high = (np.concatenate([t[k] for t in tables]) for k in (3, 5, 6, 7))
    low = np.concatenate([t[8] for t in tables])
    count = count.astype(np.int64)
    begin = np.cumsum(count) - count
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    shared = np.zeros(len(key), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    rows = np.flatnonzero(shared)
    inner = np.arange(count[rows].sum()) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
    at = np.repeat(begin[rows], count[rows]) + inner
    name = mix(np.repeat(key[rows], count[rows]) + ((high[at].astype(np.uint64) << np.uint64(8)) | low[at]) * np.uint64(0x9E3779B97F4A7C15))
    owner, place = np.repeat(doc[rows], count[rows]), np.repeat(start[rows].astype(np.int64), count[rows]) + inner
    order = np.lexsort((place, owner, name))
    new = np.concatenate(([True], name[order[1:]] != name[order[:-1]])) if len(order) else np.zeros(0, bool)
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    # the first place itself may be listed more than once, for rows that repeat
    again = order[(owner[order] != owner[first]) | (place[order] != place[first])]
    spans = [(owner[again], place[again], place[again] + window)]
    spans += [(rank_of[t[9] + b], t[10].astype(np.int64), t[11].astype(np.int64)) for t, b in zip(tables, base, strict=True)]
    owner, place, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    yield from spans_by_document(owner, place, end, ids, nulls, versions, parts)


def repeated_passages(docs: DataFrame, parts: np.ndarray, window: int = WINDOW) -> DataFrame:
    """DECISIONS: words (by place) covered by a window that also starts earlier in the corpus."""
    return by_part(anchored(docs, parts, window), parts, lambda blobs: later_windows(blobs, parts, window), DECISIONS)


def dedup_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept string, kept_sha256 of every row; kept words are joined by one space.

    Null and empty texts have no words. Earlier means a smaller id (null ids first; rows of one id by a hash of their text),
    or an earlier place in the document. Rows equal in id and text are one document. Other columns are ignored. Reads
    `docs` twice.
    """
    parts = parts_for(docs)
    joined = with_spans(docs, repeated_passages(docs, parts, window), parts)

    def run(batches):
        for block in text_blocks(batches):
            out = []
            for text, starts, ends in zip(*(block.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True):
                found = (text or "").encode().split()
                n = len(found)
                if starts:
                    found = [w for w, gone in zip(found, covered(n, starts, ends).tolist(), strict=True) if not gone]
                kept = b" ".join(found)
                out.append((n, n - len(found), kept.decode(), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([block.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))],
                                  ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
