"""Operator 9: language by the nearest of several centroids per language, on TF-IDF vectors of byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import flat, text_blocks

#: Hashed n-grams; labelled rows per language that centroids are fitted on (the only sample); centroids per language.
DIMENSIONS, SAMPLE_ROWS, CENTROIDS, ROUNDS = 4096, 1000, 4, 8
#: Texts are compared with training texts of like length (powers of four of n-grams). A text is rejected when its cosine
#: is under this share of the lowest quantile of its centroids' own members, or under the floor.
LENGTH_CLASSES, REJECT_QUANTILE, REJECT_SHARE = 10, 0.002, 0.5
BLOCK = 500_000
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[:ord("A")] = 32
_FOLD[[*range(ord("Z") + 1, ord("a")), *range(ord("z") + 1, 128)]] = 32


@dataclass
class Centroids:
    """What prediction needs; its size is set by the number of languages, not by the corpus."""

    languages: list[str]
    idf: np.ndarray
    vectors: np.ndarray
    owner: np.ndarray
    floors: np.ndarray


def counts(column: pa.Array, dimensions: int) -> np.ndarray:
    """Hashed n-gram counts (one, two and three bytes, letters folded, all else one blank) of every text."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    b = _FOLD[data]
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * dimensions
    out = np.zeros(n * dimensions, np.int64)
    for size in (1, 2, 3):
        if len(b) < size:
            break
        m = len(b) - size + 1
        code = np.full(m, 7 * size, np.int64)
        for k in range(size):
            code = code * 271 + b[k:k + m]
        code = ((code * 0x9E3779B1) >> 9) % dimensions + row[:m]
        whole = row[:m] == row[size - 1:size - 1 + m]
        out += np.bincount(code[whole], minlength=n * dimensions)
    return out.reshape(n, dimensions)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors of the counts."""
    v = np.log1p(found.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def length_class(found: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(found.sum(axis=1), 1)).astype(int) // 2, LENGTH_CLASSES - 1)


def document_frequencies(docs: DataFrame, dimensions: int) -> tuple[np.ndarray, int]:
    """In how many of all texts each n-gram is; a table of fixed size, summed by Spark."""

    def run(batches):
        total, rows = np.zeros(dimensions, np.int64), 0
        for block in text_blocks(batches, limit=BLOCK):
            total += (counts(block.column("text"), dimensions) > 0).sum(axis=0)
            rows += len(block)
        yield pa.record_batch([pa.array(np.arange(-1, dimensions)), pa.array(np.concatenate(([rows], total)))],
                              ["gram", "n"])

    summed = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(dimensions + 1, np.int64)
    for gram, n in summed.collect():
        out[gram + 1] = n
    return out[1:], int(out[0])


def cluster(v: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with far-apart first centres: centroids, and the nearest of each row."""
    chosen, near = [0], v @ v[0]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    centres = v[chosen]
    for _ in range(rounds):
        nearest = (v @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (nearest == c).any():
                centre = v[nearest == c].sum(axis=0)
                centres[c] = centre / max(np.linalg.norm(centre), 1e-12)
    return centres, (v @ centres.T).argmax(axis=1)


def fit(training: DataFrame, dimensions: int = DIMENSIONS, sample_rows: int = SAMPLE_ROWS,
        centroids: int = CENTROIDS) -> Centroids:
    """Learns from rows of (doc_id, text, lang).

    Document frequencies cover all rows; the centroids of a language are fitted in one task on about `sample_rows` of its
    rows, chosen by a hash of the id (all, if there are fewer). Rows without text or language are left out.
    """
    training = training.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    n_by_language = training.groupBy("lang").agg(F.count("*").alias("n_lang"))
    frequencies, rows = document_frequencies(training, dimensions)
    idf = (np.log((1 + rows) / (1 + frequencies)) + 0.05).astype(np.float32)
    part = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = training.join(F.broadcast(n_by_language), "lang").where(part * F.col("n_lang") <= sample_rows)

    def centres_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        found = counts(pa.array(rows["text"].tolist(), pa.string()), dimensions)
        v, length = vectors(found, idf), length_class(found)
        centres, nearest = cluster(v, centroids, ROUNDS)
        cosine = (v * centres[nearest]).sum(axis=1)
        floors = [np.quantile(cosine[length <= c], REJECT_QUANTILE) if (length <= c).any() else 0.0
                  for c in range(LENGTH_CLASSES)]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "vector": [c.astype(float).tolist() for c in centres],
                             "floors": [[float(f) for f in floors]] * len(centres)})

    fitted = sample.select("doc_id", "text", "lang").groupBy("lang").applyInPandas(
        centres_of, "lang string, vector array<double>, floors array<double>").collect()
    fitted = sorted(fitted, key=lambda r: (r["lang"], r["vector"]))
    languages = sorted({r["lang"] for r in fitted})
    return Centroids(languages, idf, np.array([r["vector"] for r in fitted], np.float32).reshape(-1, dimensions),
                     np.array([languages.index(r["lang"]) for r in fitted], int),
                     np.array([r["floors"] for r in fitted]).reshape(-1, LENGTH_CLASSES))


def classify(column: pa.Array, model: Centroids) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine with the nearest centroid, and whether that is too far, for every text."""
    texts = column.to_pylist()
    letters = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)
    if not len(model.vectors):
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    found = counts(column, len(model.idf))
    cosine = vectors(found, model.idf) @ model.vectors.T
    best = cosine.argmax(axis=1)
    score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
    floor = REJECT_SHARE * model.floors[best, length_class(found)]
    names = [model.languages[model.owner[c]] if ok else "und" for c, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, score, 0.0), ~letters | (score < floor)


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row, from the text alone.

    `und` with score 0 and rejected when the text is null or has no letter, or when no language was learned; any other text
    gets the language of its nearest centroid, and is `rejected` if even that is too far. Ties go to the first language by
    name. Repeated rows give a row each; other columns are ignored.
    """

    def run(batches):
        for block in text_blocks(batches, limit=BLOCK):
            names, score, rejected = classify(block.column("text"), model)
            yield pa.record_batch([block.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                                  ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows whose language is recognised, all columns unchanged."""

    def run(batches):
        for block in text_blocks(batches, limit=BLOCK):
            yield block.filter(pa.array(~classify(block.column("text"), model)[2]))

    return docs.mapInArrow(run, docs.schema)
