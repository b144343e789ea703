"""Operator 7: byte-level BPE over Arrow batches, with character offsets, and decoding."""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from keepwell.llm.common import text_blocks

#: The pattern of the rank files, and the same written for Python's faster `re` over the characters that
#: NOT_PLAIN leaves. Texts are split by the second only where the given pattern is the first.
RANK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?[^\s\w]+(?:[^\s\w]|_)*| ?_(?:[^\s\w]|_)*|\s+(?!\S)|\s+"
NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
MEMO_PIECES = 600_000
_LOADED: dict[tuple[str, str], PieceCoder] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for byte in range(256):
        if byte in shown:
            out[byte] = chr(byte)
        else:
            out[byte], spare = chr(spare), spare + 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def tokenizer_of_ranks(ranks: dict[bytes, int]):
    """A `tokenizers` model that merges as a rank file says: the pair whose result has the lowest rank goes first.

    Every pair of tokens whose concatenation is a token becomes a merge, in the order of the results' ranks; a piece that is
    a token itself is taken whole.
    """
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    shown = byte_characters()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [(name[token[:cut]], name[token[cut:]]) for token in sorted(ranks, key=ranks.get)
              for cut in range(1, len(token)) if token[:cut] in ranks and token[cut:] in ranks]
    tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


class PieceCoder:
    """Encodes texts piece by piece. Merges never cross a piece, so each different piece is merged once and remembered."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True
            place = {character: byte for byte, character in enumerate(byte_characters())}
            self.bytes_of = {i: bytes(place[c] for c in token) if all(c in place for c in token) else token.encode()
                             for token, i in self.tokenizer.get_vocab().items()}
        else:
            ranks = read_ranks(path)
            self.tokenizer = tokenizer_of_ranks(ranks)
            self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.plain = re.compile(PLAIN_PATTERN) if pattern == RANK_PATTERN else None
        self.sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, token in self.bytes_of.items():
            self.sizes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)
        self.used = 0

    def learn(self, pieces: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        n, total = len(self.place), int(counts.sum())
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.first) < n + len(pieces) + 1:
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
        self.ids[self.used:self.used + total] = [i for part in found for i in part]
        self.first[n] = self.used
        self.first[n + 1:n + len(pieces) + 1] = self.used + np.cumsum(counts)
        self.used += total
        self.place.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def split(self, text: str) -> list[str]:
        if self.plain is None:
            return [match.group() for match in self.pattern.finditer(text)]
        return (self.pattern if NOT_PLAIN.search(text) else self.plain).findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        if len(self.place) > MEMO_PIECES:
            self.forget()
        pieces: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            pieces += self.split(text)
            ends[k + 1] = len(pieces)
        places = list(map(self.place.get, pieces))
        if None in places:
            self.learn(list(dict.fromkeys(p for p, at in zip(pieces, places, strict=True) if at is None)))
            places = list(map(self.place.__getitem__, pieces))
        at = np.array(places, np.int64)
        first, counts = self.first[at], self.first[at + 1] - self.first[at] if len(at) else np.zeros(0, np.int64)
        done = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(first - done[:-1], counts) + np.arange(done[-1])]
        cuts = done[ends]
        return [ids[cuts[k]:cuts[k + 1]] for k in range(len(texts))]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The code point in which each token starts. Tokens that split a character share its place."""
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        starts = np.cumsum(self.sizes[ids]) - self.sizes[ids]
        return character[starts] if len(ids) else np.zeros(0, np.int64)


def coder(path: str, pattern: str) -> PieceCoder:
    """One coder for each worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = PieceCoder(path, pattern)
    return _LOADED[path, pattern]


def decode_stream(parts: Iterable[bytes]) -> Iterator[str]:
    """Text of byte parts as they come: a character split between parts appears with its last byte."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for part in parts:
        if text := decoder.decode(part):
            yield text
    if text := decoder.decode(b"", True):
        yield text


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, starts array<int> of every row: the tokens and the code points in which they start.

    Null and empty texts give empty arrays. Repeated rows and ids give a row each; other columns are ignored. `path` is a
    rank file or a tokenizer file that all executors have.
    """

    def run(batches):
        own = coder(path, pattern)
        for block in text_blocks(batches):
            texts = [t or "" for t in block.column("text").to_pylist()]
            ids = own.encode(texts)
            starts = [own.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
            yield pa.record_batch([block.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                                   pa.array(starts, pa.list_(pa.int32()))], ["doc_id", "ids", "starts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes binary, text of every row of (doc_id, ids). Bytes that are no text are replaced in `text` only."""

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            parts = [own.decode(np.array(i or [], np.int64)) for i in batch.column("ids").to_pylist()]
            texts = ["".join(decode_stream([p])) for p in parts]
            yield pa.record_batch([batch.column("doc_id"), pa.array(parts, pa.binary()), pa.array(texts, pa.string())],
                                  ["doc_id", "bytes", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoding and decoding in one pass, without the arrays.

    Null and empty texts have no tokens. Repeated rows and ids give a row each; other columns are ignored.
    """

    def run(batches):
        own = coder(path, pattern)
        for block in text_blocks(batches):
            ids = own.encode([t or "" for t in block.column("text").to_pylist()])
            yield pa.record_batch([
                block.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(own.decode(i)).hexdigest() for i in ids], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
