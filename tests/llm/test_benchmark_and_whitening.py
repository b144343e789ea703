"""Whitening, ranked search and decontamination against brute force, with the awkward cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell.llm import decontamination, ranking, whitening
from keepwell.llm.common import read_table
from keepwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[0-9a-z\u0080-\U0010FFFF]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWERED))


# ---- whitening ----------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(12))
def test_slices_find_the_leading_pairs(seed):
    rng = np.random.RandomState(seed)
    size = rng.randint(1, 30)
    part = rng.randn(size, rng.randint(1, 2 * size + 1))
    matrix = np.eye(size) * 3.0 if seed == 5 else part @ part.T
    want = np.linalg.eigvalsh(matrix)
    for shift in rng.rand(4) * want.max():
        assert whitening.count_below(matrix, shift) == (want < shift).sum()
    k = min(4, size)
    values, vectors = whitening.Spectrum(matrix).leading(k)
    assert np.allclose(values, want[::-1][:k], atol=1e-12 * want.max())
    assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-11)
    assert np.allclose(vectors @ matrix, values[:, None] * vectors, atol=1e-11 * want.max())


def whitened(rows, components=4):
    """The contract's numbers with a library's eigenvectors."""
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, total = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, vectors = values[::-1][:components], vectors[:, ::-1].T[:components]
    out = Counter()
    for i, x in good:
        along = (x - total / n) @ vectors.T / np.sqrt(values)
        for c in range(len(values)):
            out[(i, c + 1, n, int(((n * x - total) ** 2).sum()), round(abs(along[c]), 6))] += 1
    return out, values / np.trace(np.cov(fit.T.astype(float), bias=True))


def check_whitening(found, rows):
    want, explained = whitened(rows)
    assert Counter((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 6)) for r in found) == want
    for r in found:
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9


def test_whitening_of_the_table(spark):
    found = QUERIES["op11_whitening"](spark, SF).collect()
    check_whitening(found, [(r.vec_id, r.embedding) for r in read_table(spark, SF, "embeddings").collect()])


def test_whitening_of_odd_vectors(spark):
    rng = np.random.RandomState(3)
    rows = [(k, (rng.randn(6) * [5, 4, 3, 2, 1, 1]).tolist()) for k in range(200)]
    rows += [(None, rows[3][1]), (7, rows[8][1]), (300, rows[3][1]), (301, [0.0] * 6), (302, [-0.0] * 6)]
    odd = [(400, None), (401, [float("nan")] * 6), (402, [1.0, None] * 3), (403, [float("inf")] + [0.0] * 5), (404, []),
           (405, [1.0, 2.0]), (406, [1e300] * 6)]
    table = spark.createDataFrame([(i, v, "n", 0.5) for i, v in rows + odd],
                                  "vec_id long, embedding array<double>, n string, whitened double")
    check_whitening(whitening.whiten(table).collect(), rows)
    assert whitening.whiten(table.where("false")).count() == 0
    assert whitening.whiten(table.where("vec_id = 400")).count() == 0
    # one distinct vector: rows stay, and there is nothing to scale by
    one = whitening.whiten(table.where("vec_id in (3, 300)")).collect()
    assert len(one) == 8 and {(r.n, r.deviation, r.whitened, r.explained) for r in one} == {(1, 0, None, None)}
    two = whitening.whiten(table.where("vec_id in (3, 4)")).collect()
    assert {r.component for r in two if r.whitened is not None} == {1}


def test_deviations_beyond_64_bits(spark):
    rows = [(1, [2.0**50, 0.0]), (2, [-(2.0**50), 1.0]), (3, [0.5, 2.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 6
    by_id = {r.vec_id: r.deviation for r in found}
    assert by_id[1] is None and by_id[3] == 128**2 * 4 + (3 * 512 - 768) ** 2


# ---- ranked search ------------------------------------------------------------------------------
def ranked(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    joined = {}
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        joined.setdefault(item, Counter()).update(words(text))
    out = []
    for item, asked in joined.items():
        scores = []
        for name, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, name is not None, name or 0))
        out += [(item, rank, name if known else None, -score)
                for rank, (score, known, name) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def check_ranks(spark, docs, items, k=10, **sizes):
    d = spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id long, text string, rank string, n int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    found = ranking.rank_documents(d, b, k, **sizes).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found) == ranked(docs, items, k)
    return found


def test_ranks_of_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    found = QUERIES["op12_ranked_search"](spark, SF).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found) == ranked(docs, items, 10)
    # several parts of items, small trees, and first bounds from few documents give the same
    check_ranks(spark, docs, items, part_items=7, part_words=200, tree_rows=16, seed_rows=20)


def test_ranks_of_odd_texts(spark):
    copies = [(k, "Alpha beta gamma") for k in range(40, 0, -1)]
    docs = [*copies, (None, "alpha beta gamma"), (None, "alpha beta gamma"), (5, "ALPHA! beta\x00delta"), (90, None), (91, ""),
            (92, " -- "), (93, "Éa éa ÉA 日本 alpha"), (94, "beta " * 5000), (95, "delta 7 7 7")]
    items = [(1, "alpha beta"), (1, "alpha beta"), (1, "beta gamma delta"), (None, "7 alpha"), (2, None), (3, ""), (4, "日本 éa"),
             (5, "nowhere"), (6, "beta " * 300 + "delta")]
    check_ranks(spark, docs, items, k=10, tree_rows=8, seed_rows=4)
    check_ranks(spark, docs, [])
    check_ranks(spark, [], items)


def test_long_items_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SLICE_BYTES", 64)
    docs = [(k, " ".join(f"w{(k * j) % 23}" for j in range(1, 60))) for k in range(50)]
    heavy = [(1, " ".join(["w1 w2 w3"] * 20)), (2, "w5 w5 w7")]
    check_ranks(spark, docs, heavy)
    items = ranking.Items([1], np.array([[2**45, 3, 2**44]]))
    assert not items.exact
    search = ranking.Search(items, 2, np.zeros(1))
    search.add(ranking.Documents([4, 5, 6], np.array([0, 2, 3, 5]), np.array([0, 1, 2, 0, 1]), np.array([1000, 5, 999, 1000, 6])))
    assert list(search.results()) == [(0, 6, 2**45 * 1000 + 18), (0, 4, 2**45 * 1000 + 15)]


def test_bounds_skip_batches():
    rng = np.random.RandomState(0)
    weights = np.zeros((64, 64), np.int64)
    weights[np.arange(64), np.arange(64)] = 1000
    docs = 4096
    places = np.sort(rng.randint(0, 64, (docs, 1)), axis=1).ravel()
    search = ranking.Search(ranking.Items(list(range(64)), weights), 10, np.zeros(64))
    search.add(ranking.Documents(list(range(docs)), np.arange(docs + 1), places, rng.randint(1, 1000, docs)))
    assert search.pairs < docs * 64 / 10
    assert sum(1 for _ in search.results()) == 640


# ---- decontamination ----------------------------------------------------------------------------
def hits(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for at in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[at:at + size]), set()).add("" if item is None else str(item))
    sizes = sorted({len(w) for w in windows})
    out = []
    for name, text in docs:
        w, marked, found = words(text), set(), set()
        for size in sizes:
            for at in range(len(w) - size + 1):
                if tuple(w[at:at + size]) in windows:
                    marked.update(range(at, at + size))
                    found |= windows[tuple(w[at:at + size])]
        joined = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((name, len(w), len(marked), len(found), joined, bool(marked)))
    return Counter(out)


def as_rows(found):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect())


def tables(spark, docs, items):
    return (spark.createDataFrame([(i, t, "w", 3) for i, t in docs], "doc_id long, text string, found string, n_hit int"),
            spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, whole string"))


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "a rose is a rose is a rose is a rose is a rose"),
         (3, "Short Item"), (4, "solo"), (None, "nothing is as it was"), (5, None), (6, ""), (7, "--"), (1, "short item"),
         (8, " ".join(f"t{k % 7}" for k in range(90))), (9, "x y " * 30)]
DOCS = [(1, "and ONE two three, four five six seven eight nine ten; eleven thirteen"), (2, "two three four five six seven eight nine ten"),
        (3, "is a rose is a rose is a rose is a rose is a"), (4, "the short item and the solo"), (5, "nothing is as it was here"),
        (6, None), (7, ""), (8, "!!"), (None, "short\x00item"), (None, "short\x00item"), (9, "x y " * 400 + "z " + "x y " * 6),
        (10, " ".join(f"t{k % 7}" for k in range(3, 300))), (11, "Soló solo"), (12, "one two three four five six seven eight nine " * 3)]


def test_hits_of_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    want = hits(docs, items)
    assert any(row[5] for row in want)
    assert as_rows(QUERIES["op13_decontamination"](spark, SF)) == want


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_hits_of_odd_texts(spark, window):
    docs, items = tables(spark, DOCS, ITEMS)
    assert as_rows(decontamination.report(docs, items, window)) == hits(DOCS, ITEMS, window)


def test_many_automata_and_slices_give_the_same(spark, monkeypatch):
    docs, items = tables(spark, DOCS, ITEMS)
    want = decontamination.find(docs, items).select("doc_id", "found").collect()
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 25)
    parts = decontamination.find(docs, items, part_words=60).select("doc_id", "found").collect()
    for mine, whole in zip(sorted(parts, key=str), sorted(want, key=str), strict=True):
        assert mine.doc_id == whole.doc_id
        assert mine.found.asDict() | {"longest": 0} == whole.found.asDict() | {"longest": 0}


@pytest.mark.parametrize("limit", [8, 40, 300])
def test_slices_of_long_texts(limit):
    import pyarrow as pa

    pieces = [(k, len(words(t)) < 10, [w.encode() for w in words(t)]) for k, (_, t) in enumerate(ITEMS) if words(t)]
    automaton = decontamination.Automaton(pieces, 10)
    for _, text in DOCS:
        column = pa.array([text], pa.string())
        assert decontamination.Reader(automaton, limit).read(column) == decontamination.Reader(automaton).read(column)


def test_cleaning_removes_spans_and_covered_documents(spark):
    docs, items = tables(spark, DOCS, ITEMS)
    found = {r.doc_id: r for r in decontamination.clean_documents(docs, items).where("doc_id is not null").collect()}
    assert docs.columns[:2] == ["doc_id", "text"] and "found" not in next(iter(found.values())).asDict()
    assert 1 not in found and 5 not in found and 9 not in found
    assert found[2].text == DOCS[1][1] and found[6].text is None and found[7].text == ""
    assert found[11].text == "Soló " and found[4].text == "the  and the "
    assert decontamination.clean_documents(docs, items, most_covered=1.0).count() == len(DOCS)
    assert decontamination.clean_documents(docs, items.where("false")).count() == len(DOCS)
    assert decontamination.report(docs.where("false"), items).count() == 0
    assert decontamination.report(docs, items.where(F.col("item_id") == 7)).where("contaminated").count() == 0
