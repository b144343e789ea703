"""Operator 13: benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton of all items reads the words of a document one by one and knows at each of them the longest run of words, ending
there, that some item holds. A run as long as a window is a hit; items shorter than a window must be met whole. Documents are
never shuffled. An automaton takes at most `PART_WORDS` words of items, so what is broadcast has a size bound; longer
benchmarks are cut into several automata, each of which reads the documents once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import flat, hash_spans, spans_between, stored, text_blocks

#: Words of items in one automaton, and in one piece of an item; bytes of text that are read at once.
PART_WORDS, PIECE_WORDS, SLICE_BYTES = 100_000, 2_000, 2_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: After lower-casing, words are runs of digits, letters a to z and all bytes of other characters.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
FOUND = "struct<n_words: bigint, first: array<bigint>, end: array<bigint>, longest: bigint, items: array<string>>"
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def normalised_words(text: str) -> list[bytes]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = spans_between(data, np.array([0, len(data)]), BETWEEN)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


# ---- the automaton ------------------------------------------------------------------------------
class Automaton:
    """A generalised suffix automaton of word sequences, with the items of every window.

    `longest[s]` is the length of the longest run of state s, `link[s]` the state of its longest suffix in another state. Runs
    of one length are never in one state, so each window has a state of its own: `windows[s]` holds its (length, items).
    """

    def __init__(self, pieces: Iterable[tuple[int, bool, list[bytes]]], window: int):
        """`pieces` are (item number, whether the piece is a whole item, words)."""
        pieces = list(pieces)
        self.window = window
        self.number: dict[bytes, int] = {}
        for _, _, words in pieces:
            for word in words:
                self.number.setdefault(word, len(self.number))
        self.base = len(self.number)
        self.link, self.longest, moves = [-1], [0], [{}]
        coded = [(item, whole, [self.number[w] for w in words]) for item, whole, words in pieces]
        for _, _, codes in coded:
            self._add(codes, moves)
        self.next_of = {state * self.base + code: after for state, found in enumerate(moves) for code, after in found.items()}
        self.windows: dict[int, tuple[int, set[int]]] = {}
        self.least = window
        pairs, firsts = set(), set()
        for item, whole, codes in coded:
            size = min(window, len(codes)) if whole else window
            if not size or len(codes) < size:
                continue
            self.least = min(self.least, size)
            pairs.update(zip(codes, codes[1:], strict=False))
            firsts.update(codes)
            for end, state, _ in self.walk(codes):
                if end + 1 >= size:
                    self.windows.setdefault(self._suffix(state, size), (size, set()))[1].add(item)
        self._hashes(pairs, firsts)
        self._nearest()

    def _add(self, codes: list[int], moves: list[dict[int, int]]) -> None:
        """Adds a sequence, starting from the empty run, so that no run joins two sequences."""
        last = 0
        for code in codes:
            ready = moves[last].get(code)
            if ready is not None and self.longest[ready] == self.longest[last] + 1:
                last = ready
                continue
            if ready is not None:
                last = self._split(last, code, ready, moves)
                continue
            new = len(moves)
            self.longest.append(self.longest[last] + 1)
            self.link.append(0)
            moves.append({})
            state = last
            while state >= 0 and code not in moves[state]:
                moves[state][code] = new
                state = self.link[state]
            if state >= 0:
                after = moves[state][code]
                if self.longest[after] == self.longest[state] + 1:
                    self.link[new] = after
                else:
                    self.link[new] = self._split(state, code, after, moves)
            last = new

    def _split(self, state: int, code: int, after: int, moves: list[dict[int, int]]) -> int:
        """A state of its own for the runs of `after` that come by `state`."""
        copy = len(moves)
        self.longest.append(self.longest[state] + 1)
        self.link.append(self.link[after])
        moves.append(dict(moves[after]))
        self.link[after] = copy
        while state >= 0 and moves[state].get(code) == after:
            moves[state][code] = copy
            state = self.link[state]
        return copy

    def _suffix(self, state: int, size: int) -> int:
        """The state of the last `size` words of a run."""
        while self.longest[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _nearest(self) -> None:
        """For each state the nearest one that is a window, itself or along its links."""
        order = sorted(range(len(self.link)), key=self.longest.__getitem__)
        self.nearest = [-1] * len(self.link)
        for state in order:
            up = self.link[state]
            self.nearest[state] = state if state in self.windows else (self.nearest[up] if up >= 0 else -1)

    def _hashes(self, pairs: set[tuple[int, int]], singles: set[int]) -> None:
        """Sorted hashes of all words and pairs of neighbours, which tell most text from any item at once."""
        words = list(self.number)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        named = hash_spans(data, starts, ends)
        self.word_hashes = np.unique(named[sorted(singles)]) if singles else np.zeros(0, np.uint64)
        two = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_hashes = np.unique(named[two[:, 0]] * _PAIR + named[two[:, 1]])

    def walk(self, codes: Iterable[int | None]) -> Iterator[tuple[int, int, int]]:
        """Place, state and length of the longest run that ends there, for every word that is in some item."""
        state = length = 0
        get, link, longest, base = self.next_of.get, self.link, self.longest, self.base
        for place, code in enumerate(codes):
            if code is None:
                state = length = 0
                continue
            after = get(state * base + code)
            while after is None and state:
                state = link[state]
                length = longest[state]
                after = get(state * base + code)
            if after is not None:
                state = after
                length += 1
                yield place, state, length

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int, set[int]]]:
        """(first place, end, length of the longest run, items) of every window in the words."""
        windows, nearest, link = self.windows, self.nearest, self.link
        for place, state, length in self.walk(map(self.number.get, words)):
            at = nearest[state]
            while at >= 0:
                size, items = windows[at]
                if size <= length:
                    yield place + 1 - size, place + 1, length, items
                at = nearest[link[at]]


def _known(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


def stretches(hashes: np.ndarray, text: np.ndarray, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of words (first, end) whose words and neighbouring pairs all are in items, long enough for a window."""
    known = _known(hashes, automaton.word_hashes)
    joined = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        both = np.flatnonzero(known[1:] & known[:-1] & (text[1:] == text[:-1])) + 1
        joined[both] = _known(hashes[both - 1] * _PAIR + hashes[both], automaton.pair_hashes)
    first = np.flatnonzero(known & ~joined)
    if not len(first):
        return first, first
    # a run ends where the next word is unknown or starts another run
    stops = np.append(known & joined, False)[1:]
    end = np.flatnonzero(known & ~stops) + 1
    long_enough = end - first >= automaton.least
    return first[long_enough], end[long_enough]


# ---- reading documents --------------------------------------------------------------------------
def _slices(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes in slices of about `limit`, cut between words, and the offsets of the texts in each.

    Only a text longer than the limit is cut.
    """
    if len(data) <= limit or len(offsets) != 2:
        yield data, offsets
        return
    start = 0
    while start < len(data):
        end = min(start + limit, len(data))
        while end < len(data) and not BETWEEN[LOWER[data[end]]]:
            end += 1
        yield data[start:end], np.array([0, end - start])
        start = end


class Reader:
    """Marks the hit words of texts."""

    def __init__(self, automaton: Automaton, limit: int = SLICE_BYTES):
        self.automaton, self.limit = automaton, limit

    def read(self, column: pa.Array) -> list[tuple[int, list[tuple[int, int]], int, set[int]]]:
        """For each text: number of words, hit words as disjoint runs (first, end), longest run, items."""
        data, offsets = flat(column)
        out = [[0, [], 0, set()] for _ in range(len(offsets) - 1)]
        tail: list[bytes] = []
        for part, edges in _slices(data, offsets, self.limit):
            self._slice(LOWER[part], edges, out, tail, carry=len(out) == 1)
        return [(n, joined(hits), longest, items) for n, hits, longest, items in out]

    def _slice(self, data: np.ndarray, edges: np.ndarray, out: list, tail: list[bytes], carry: bool) -> None:
        starts, ends, text = spans_between(data, edges, BETWEEN)
        raw = data.tobytes()
        if carry and tail:
            # the last words of the slice before come first again, as a run may go on
            head = b" ".join(tail) + b" "
            raw = head + raw
            data = np.frombuffer(raw, np.uint8)
            starts, ends, text = spans_between(data, np.array([0, len(data)]), BETWEEN)
        again = len(tail) if carry else 0
        first_word = np.searchsorted(text, np.arange(len(edges)))
        before = [entry[0] for entry in out]
        for t in range(len(out)):
            out[t][0] += int(first_word[t + 1] - first_word[t]) - (again if t == 0 else 0)
        for first, end in zip(*(a.tolist() for a in stretches(hash_spans(data, starts, ends), text, self.automaton)),
                              strict=True):
            entry = out[text[first]]
            shift = before[text[first]] + first - int(first_word[text[first]]) - (again if text[first] == 0 else 0)
            words = [raw[s:e] for s, e in zip(starts[first:end].tolist(), ends[first:end].tolist(), strict=True)]
            for at, stop, length, items in self.automaton.matches(words):
                entry[1].append((at + shift, stop + shift))
                entry[2] = max(entry[2], length)
                entry[3] |= items
        if carry:
            keep = len(starts) - max(self.automaton.longest)
            tail[:] = [raw[s:e] for s, e in zip(starts[max(keep, 0):].tolist(), ends[max(keep, 0):].tolist(), strict=True)]


def joined(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as disjoint runs in order."""
    out: list[list[int]] = []
    for first, end in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


# ---- items --------------------------------------------------------------------------------------
def item_pieces(benchmark: DataFrame, window: int, key: str, column: str) -> DataFrame:
    """(item, whole, words, n) of every distinct item text, long ones cut in pieces that share window - 1 words; stored.

    `item` is the id as text, empty for a null one.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normalised_words(text or "")
                step = max(PIECE_WORDS, 2 * window) - (window - 1)
                for at in range(0, max(len(words) - (window - 1), 1), step):
                    piece = words[at:at + step + window - 1]
                    if piece:
                        rows.append((item, len(words) < window, b" ".join(piece), len(piece)))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["item", "whole", "words", "n"]), pa.schema(
                [("item", pa.string()), ("whole", pa.bool_()), ("words", pa.binary()), ("n", pa.int64())]), preserve_index=False)

    items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(column).alias("text"))
    pieces = items.where("text is not null").distinct().mapInArrow(run, "item string, whole boolean, words binary, n long")
    return stored(pieces.distinct(), "benchmark-pieces")


def automata(pieces: DataFrame, window: int, part_words: int) -> Iterator[tuple[Automaton, list[str]]]:
    """Automata over all pieces, none of more than `part_words` words (or one piece), and the item ids they number.

    Pieces are dealt by hash into as many parts as it takes; one part at a time is on the driver.
    """
    words = pieces.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-words // part_words))
    while True:
        place = F.pmod(F.xxhash64("item", "words"), F.lit(parts))
        largest = pieces.groupBy(place.alias("part")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= max(part_words, PIECE_WORDS):
            break
        parts *= 2
    for part in range(parts):
        rows = sorted(pieces.where(place == part).select("item", "whole", "words").collect())
        ids = sorted({r["item"] for r in rows})
        number = {item: k for k, item in enumerate(ids)}
        yield Automaton(((number[i], whole, bytes(w).split(b" ")) for i, whole, w in rows), window), ids


# ---- the operator -------------------------------------------------------------------------------
def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "item_id", column: str = "text",
         part_words: int = PART_WORDS) -> DataFrame:
    """All columns of `docs` and `found`: n_words, hit words as disjoint runs `first` and `end`, `longest`, item ids.

    Words are runs of digits, letters and characters beyond ASCII; A to Z count as a to z. Each `window` consecutive words of
    an item that a document holds are a hit; an item of fewer words is hit by all of them. Null and empty texts have no words;
    an item without words is never hit. `longest` is the longest run of words that a piece of an item (`PIECE_WORDS`) holds, if a
    window is in it. Rows of one item id are one item; a null id is one item, whose id is empty text. A
    document of any length is read whole, in slices. Repeated rows keep a row each. If `docs` has a column `found`, it is replaced.
    """
    docs = docs.drop("found")
    out = docs.withColumn("found", F.lit(None).cast(FOUND))
    for number, (automaton, ids) in enumerate(automata(item_pieces(benchmark, window, key, column), window, part_words)):
        if number:  # one automaton at a time in the memory of a task
            out = stored(out, "decontamination")
        shared = docs.sparkSession.sparkContext.broadcast((automaton, ids))
        out = out.mapInArrow(_marker(shared), out.schema)
    return out


def _marker(shared):
    def run(batches):
        automaton, ids = shared.value
        reader = Reader(automaton)
        for block in text_blocks(batches):
            at = block.schema.get_field_index("found")
            rows = []
            for old, (n, hits, longest, items) in zip(block.column(at).to_pylist(), reader.read(block.column("text")), strict=True):
                names = {ids[i] for i in items}
                if old:  # an automaton before this one
                    hits = joined([*hits, *zip(old["first"], old["end"], strict=True)])
                    longest, names = max(longest, old["longest"]), names | set(old["items"])
                rows.append({"n_words": n, "first": [a for a, _ in hits], "end": [b for _, b in hits], "longest": longest,
                             "items": sorted(names)})
            yield block.set_column(at, block.schema.field(at), pa.array(rows, block.schema.field(at).type))

    return run


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest of every row; see `find`."""
    found = find(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate(F.zip_with("found.end", "found.first", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    names = F.array_join("found.items", ",")
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("found.items") > 0).alias("contaminated"), F.col("found.longest").alias("longest"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_covered: float = 0.5) -> DataFrame:
    """The documents without the words that are hit; a document of which more than `most_covered` is hit goes.

    A removed run goes with all between its first and last word. Documents without a hit stay as they are, nulls included.
    Columns are those of `docs`.
    """
    found = find(docs, benchmark, window)

    def run(batches):
        for block in text_blocks(batches):
            texts, keep = [], []
            for text, hit in zip(block.column("text").to_pylist(), block.column("found").to_pylist(), strict=True):
                gone = sum(b - a for a, b in zip(hit["first"], hit["end"], strict=True)) if hit else 0
                keep.append(not gone or gone <= most_covered * hit["n_words"])
                texts.append(without(text, hit["first"], hit["end"]) if gone and keep[-1] else text)
            at = block.schema.get_field_index("text")
            block = block.set_column(at, block.schema.field(at), pa.array(texts, block.schema.field(at).type))
            yield block.filter(pa.array(keep, pa.bool_())).drop_columns(["found"])

    return found.mapInArrow(run, docs.drop("found").schema)


def without(text: str, first: list[int], end: list[int]) -> str:
    """A text without runs of its words."""
    raw = text.encode()
    data = LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, _ = spans_between(data, np.array([0, len(data)]), BETWEEN)
    out, at = [], 0
    for a, b in zip(first, end, strict=True):
        out.append(raw[at:starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()
