"""The training-data operators against brute force, round trips and held-out accuracy, with the awkward cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keepwell.llm import blobs, bpe, imatch, language, lines, near, packing, pii, recompression, suffixes, vantage
from keepwell.llm.common import read_table
from keepwell.llm.queries import QUERIES, pattern, vocabulary

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 30_000
PASSAGE = " ".join(f"word{k}" for k in range(60))
ODD = [
    (1, None), (2, ""), (3, "   \n\n "), (4, "ü"), (5, PASSAGE), (6, PASSAGE), (7, f"start here {PASSAGE} and end"),
    (7, f"start here {PASSAGE} and end"), (8, LONG), (9, "a" * 5000), (10, "x " * 500), (None, PASSAGE), (11, "12 !? 34"),
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = read_table(spark, SF, "documents").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "k", "z") for i, t in ODD],
                                 "doc_id long, text string, lang string, source string, n_chars long, key string, part string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def run(spark, prefix):
    return QUERIES[next(n for n in QUERIES if n.startswith(f"{prefix}_"))](spark, SF).collect()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_vantage_trees_are_exact_with_factor_one(spark):
    rows = [(k, v) for k, v in enumerate(np.random.RandomState(1).randn(700, 8).tolist())]
    rows += [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [1.0, None] * 4), (704, rows[3][1]), (705, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vantage.nearest(table, F.col("vec_id") % 20 == 0, k=5, shard_rows=100).collect()
    good = {i: np.array(v) for i, v in rows if i < 700 or i > 703}
    for query in range(0, 700, 20):
        best = sorted((-float(sum(a * b for a, b in zip(good[query], v))), i) for i, v in good.items() if i != query)[:5]
        mine = sorted((r["rank"], r.vec_id) for r in found if r.query_id == query)
        assert [i for _, i in mine] == [i for _, i in best]
    assert vantage.nearest(table.where("false"), F.col("vec_id") == 0).count() == 0
    relaxed = {(r.query_id, r.vec_id) for r in vantage.nearest(table, F.col("vec_id") % 20 == 0, 5, 2.0, 1000).collect()}
    assert relaxed <= {(r.query_id, r.vec_id) for r in vantage.nearest(table, F.col("vec_id") % 20 == 0, 700).collect()}


def removed_strings(texts: list[str], length: int) -> list[tuple[int, int, str]]:
    data = [t.encode() for t in texts]
    counts = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append((sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(b for b, g in zip(d, gone) if not g))))
    return out


def test_vantage_ties_repeated_ids_and_other_columns(spark):
    chance = np.random.RandomState(3)
    rows = [(k, [1.0, 0.5, 0.25, 2.0] if k % 2 else chance.randn(4).tolist(), "n") for k in range(600)]
    rows += [(None, [9.0] * 4, "n"), (7, [9.0, 9.0, 9.0, 9.0], "n"), (11, [0.1, 0.0, 0.0, 0.0], "n"), (601, None, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string")
    found = vantage.nearest(table, F.col("vec_id") % 20 == 0, k=6, shard_rows=150).collect()
    for query in range(0, 600, 20):
        own = rows[query][1]
        score = lambda v: ((own[0] * v[0] + own[1] * v[1]) + own[2] * v[2]) + own[3] * v[3]
        best = sorted((-score(v), i) for i, v, _ in rows if i is not None and i != query and v)[:6]
        mine = sorted((r["rank"], -r.score, r.vec_id) for r in found if r.query_id == query)
        assert [(score, i) for _, score, i in mine] == best
    small = spark.createDataFrame([(0, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [9.0, 0.0]), (6, [2.0, 0.0])], "vec_id long, embedding array<double>")
    listed = vantage.nearest(small, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in listed] == [(5, 9.0), (6, 2.0), (5, 1.0)]


def test_suffix_sorting_by_brute_force(spark, documents):
    want = dict(zip(documents, removed_strings(list(documents.values()), 200)))
    for r in run(spark, "op2"):
        assert (r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_suffix_sorting_of_odd_texts(odd, empty):
    texts = [t or "" for _, t in ODD if t != LONG]
    found = suffixes.dedup_strings(odd.where(F.length(F.coalesce("text", F.lit(""))) < 100_000)).collect()
    assert Counter((r.n_removed, r.n_spans, r.kept_sha256) for r in found) == Counter(removed_strings(texts, 200))
    assert suffixes.dedup_strings(odd).count() == len(ODD)
    assert suffixes.dedup_strings(empty).count() == 0


def test_recompression_by_brute_force(spark, documents):
    seen, found = set(), {r.doc_id: r for r in run(spark, "op4")}
    for doc in sorted(documents):
        words = documents[doc].encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i:i + 20])
            if window in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        assert (found[doc].n_words, found[doc].n_removed, found[doc].kept_sha256) == (len(words), sum(gone), sha(kept))


def test_recompression_of_odd_texts(odd, empty):
    found = {(r.doc_id, r.n_words): r.n_removed for r in recompression.dedup_passages(odd).collect()}
    assert found[None, 60] == 0 and found[5, 60] == 60 and found[6, 60] == 60 and found[7, 64] == 60
    assert found[1, 0] == 0 and found[10, 500] == 499 and found[9, 1] == 0
    assert recompression.dedup_passages(empty).count() == 0


def test_decided_spans_travel_in_a_row_for_all_documents_of_a_part(spark):
    chance = np.random.RandomState(5)
    shared = [" ".join(map(str, chance.randint(0, 10**6, 60))) for _ in range(20)]
    texts = [f"own{k} " + " ".join(shared[j] for j in chance.permutation(20)[:10]) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    parts = blobs.parts_for(docs)
    for decided in (recompression.repeated_passages(docs, parts), suffixes.repeated_strings(docs, parts)):
        # a row for each document and part would be about 300 x 8; op2 has two steps that decide
        assert 0 < decided.count() <= 2 * len(parts) ** 2 < 300
        spans = blobs.with_spans(docs, decided, parts).collect()
        assert len(spans) == 300 and all(e < s for r in spans for e, s in zip(r.ends or [], (r.starts or [])[1:]))


def test_null_ids_are_not_taken_for_zero(spark):
    text = f"{PASSAGE} between {PASSAGE}"
    docs = spark.createDataFrame([(None, text), (0, text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in recompression.dedup_passages(docs).collect()} == {None: 60, 0: 121}


def test_line_dedup(spark, odd, empty):
    text = "one two three four five\nsix seven eight nine\n\nten eleven twelve"
    docs = spark.createDataFrame([(1, text), (2, f"new line of the second document\n{text}"), (3, None), (4, "")],
                                 "doc_id long, text string")
    found = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert found[1].n_removed == 0 and found[2].kept == "new line of the second document"
    assert found[3].kept is None and found[4].n_lines == 1
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    kept = lines.dedup_documents(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id = 7").count() == 2
    assert lines.dedup_lines(empty).count() == 0 and lines.dedup_documents(empty).count() == 0


def test_line_dedup_meets_every_earlier_holder(spark):
    short = [f"short line {k}" for k in range(6)]
    one, two = "the first line has six words", "the second line has six words"
    rows = [(k, f"text {k} alone\n{line}\nend {k} here") for k, line in enumerate(short)]
    rows += [(10, "\n".join(short)), (11, "\n".join(short)), (20, f"{two}\n{one}"), (21, f"{one}\n{two}"), (22, f"{one}\n{two}")]
    found = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[10] == 0 and found[11] == 6 and found[22] == 2
    chance = np.random.RandomState(5)
    for _ in range(200):
        a, b = ([int(x) for x in chance.randint(1, 5, chance.randint(1, 12))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        pairs = lines.common(a, b)
        assert len(pairs) == table[-1, -1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(lines.patience([9, 1, 2, 1, 2, 8], [7, 1, 2, 1, 2, 6])) == 4


def test_personal_data_by_plain_patterns(spark, documents):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, text):
        digits = [int(c) for c in text if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in text.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and pii.luhn("".join(map(str, digits)))
        return kind == "email" or 8 <= len(digits) <= 15

    extra = "a@b.c@d.e x@y.z.w@q 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111-1111 1111 +49 (30) 123-45 67x +1 2345678 a.b@-.-"
    for text in [*documents.values(), extra, "@" * 50, "1." * 300, "+" * 40 + "1 2 3 4 5 6 7 8"]:
        want = [(k, *m.span()) for k, p in kinds.items() for m in re.finditer(p, text) if good(k, m[0])]
        assert [x[:3] for x in pii.find(text) if x[0] in kinds] == want


def test_personal_data_checks_and_context(odd, empty):
    found = pii.find("account DE89370400440532013000 and DE88370400440532013000; social security 123-45-6789" + " and" * 15 + " part 123-45-6789")
    assert [x[0] for x in found] == ["iban", "ssn"] and found[0][3] == 1.0
    assert pii.masked("mail a@b.de now", pii.find("mail a@b.de now")) == "mail [EMAIL] now"
    kept = pii.mask_documents(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) and pii.personal_data(empty).count() == 0
    assert pii.personal_data(odd).where("doc_id = 1 and spans = '' and masked is null").count() == 1


def test_account_codes_before_other_words():
    for code, after in (("DE89370400440532013000", " BIC COBADEFFXXX"), ("DE89 3704 0044 0532 0130 00", " EUR 100"),
                        ("DE89370400440532013000", "")):
        for before in ("IBAN ", "AB12 "):
            assert [x[:3] for x in pii.find(before + code + after) if x[0] == "iban"] == [("iban", 5, 5 + len(code))]


def test_near_duplicates_by_brute_force(spark, documents, odd, empty):
    from keepwell.llm.common import words

    values = {}
    for doc, text in documents.items():
        data = np.frombuffer(text.encode(), np.uint8)
        values[doc] = words(data, np.array([0, len(data)]))[2]
    parent = {d: d for d in documents}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in documents:
        for b in documents:
            if a < b and top(a) != top(b) and (documents[a] == documents[b] or near.similarity(values[a], values[b]) > 0):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    assert {r.doc_id: r.class_id for r in run(spark, "op6")} == {d: top(d) for d in documents}
    kept = near.dedup_documents(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {None, 1, 3, 4, 8, 9, 10, 11}
    assert near.near_duplicates(empty).count() == 0


def test_near_duplicates_in_large_mixed_buckets(spark):
    passage = " ".join(f"common{k}" for k in range(76))
    rows = [(i, f"{passage} " + " ".join(f"own{i}x{k}" for k in range(28))) for i in range(200)]
    rows += [(1000 + i, f"{text} more") for i, text in rows[100:110]]
    rows += [(2000, "one two three four five six seven eight"), (2001, "one two three four five six seven eight nine")]
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), sketches=1, minima=1).collect()
    classes = {r.key.doc_id: r.class_key.doc_id for r in found}
    assert classes == {i: i - 1000 if 1000 <= i < 2000 else min(i, 2000) for i, _ in rows}
    # four of five shingles are shared
    short = near.near_duplicates(spark.createDataFrame(rows[-2:], "doc_id long, text string")).collect()
    assert {r.class_key.doc_id for r in short} == {2000}


def test_banded_alignment():
    chance = np.random.RandomState(3)
    for _ in range(200):
        a, b = chance.randint(0, 4, chance.randint(0, 14)), chance.randint(0, 4, chance.randint(0, 14))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        table[0], table[:, 0] = np.arange(len(b) + 1), np.arange(len(a) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = min(table[i, j] + (a[i] != b[j]), table[i, j + 1] + 1, table[i + 1, j] + 1)
        assert near.edit_distance(a, b, 20) == table[-1, -1]
        assert near.edit_distance(a, b, int(table[-1, -1]) - 1) is None


@pytest.mark.parametrize("part", [1, 7, 4096])
def test_alignment_in_parts_by_brute_force(monkeypatch, part):
    monkeypatch.setattr(near, "PART", part)
    chance = np.random.RandomState(part)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            before, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
        return row[-1]

    for turn in range(300):
        a = chance.randint(0, chance.randint(2, 30), chance.randint(0, 30))
        b = np.delete(a, chance.randint(0, len(a), 3)) if turn % 2 and len(a) else chance.randint(0, 5, chance.randint(0, 30))
        limit, distance = chance.randint(0, 32), plain(a.tolist(), b.tolist())
        assert near.edit_distance(a, b, limit) == (distance if distance <= limit else None)


def test_shingle_join_misses_no_similar_pair(spark):
    chance = np.random.RandomState(2)
    base = chance.randint(-2**62, 2**62, 120)
    sets = [np.unique(np.where(chance.rand(120) < share, chance.randint(-2**62, 2**62, 120), base))
            for share in chance.choice([0.02, 0.08, 0.12, 0.3], 60)] + [base[:5], base[:6], base[:0]]
    rows = [((k, 0), np.sort(x).tolist()) for k, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "key struct<doc_id: long, version: long>, shingles array<long>").where(F.size("shingles") > 0)
    none = table.where("false").select("key", F.col("key").alias("component"))
    found = {(r.a.doc_id, r.b.doc_id) for r in near.alike(near.prefixes(table, 0.8), none, 0.8).collect()}
    like = {(i, k) for k in range(len(sets)) for i in range(k) if near.jaccard(np.sort(sets[i]), np.sort(sets[k]), 0.8) >= 0.8}
    assert like and like <= found and len(found) < len(sets) ** 2 / 4


def test_tokens_equal_those_of_the_rank_library(documents):
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    own = bpe.coder(path, pattern())
    signs = [f"a{chr(c)}1 {chr(c)}{chr(c)} {chr(c)}b\n{chr(c)} x" for c in [*range(0x3000), *range(0x1F300, 0x1F400)]]
    texts = [*documents.values(), *signs, "don't 'sam ''s _a_b __ x_ \t\n  y  ", "<|endoftext|>", "²½ª", "\x1c\x1fa\x85b"]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
        assert len(own.offsets(text, ids)) == len(ids)


def test_packing_encoder_equals_the_tokenizers_library(documents):
    own = packing.encoder(vocabulary("byte_bpe_50k.json"), pattern())
    signs = [f"a{chr(c)}1 {chr(c)}{chr(c)} {chr(c)}b\n{chr(c)} x" for c in range(0, 0xD800, 3)]
    for text in [*documents.values(), *signs, "<|endoftext|>", " " * 300_000]:
        assert own.encode(text).tolist() == own.exact.encode(text, add_special_tokens=False).ids


def test_split_characters_decode_as_they_come():
    data = "aü€😀".encode()
    assert "".join(bpe.decode_stream(bytes([b]) for b in data)) == "aü€😀"


def test_encode_and_decode_round_trip(odd, empty):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.encode(odd, path, pattern())
    back = Counter(r.text for r in bpe.decode(tokens, path, pattern()).collect())
    assert back == Counter(t or "" for _, t in ODD) and bpe.round_trip(empty, path, pattern()).count() == 0


def test_fingerprints(spark, documents, odd, empty):
    found = {r.doc_id: r for r in run(spark, "op8")}
    order = sorted(documents, reverse=True)
    for k, doc in enumerate(order):
        text, following = documents[doc], documents[order[(k + 1) % len(order)]]
        cut = len(text) // 3
        assert found[doc].edited_sha256 == sha((text[:len(text) - cut] + following[:cut]).encode())
    by_text = defaultdict(set)
    for doc, text in documents.items():
        by_text[text].add(found[doc].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r.near_edited for r in found.values()]) > 0.3 > 0.1 > np.mean([r.near_next for r in found.values()])
    band = imatch.band(odd)
    assert imatch.edited_fingerprints(odd, band).count() == len(ODD)
    assert imatch.fingerprints(odd, band).count() == len(ODD)
    assert imatch.edited_fingerprints(empty, band).count() == 0


def test_languages(spark, odd, empty):
    docs = read_table(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = [r for r in run(spark, "op9") if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in found]) > 0.85
    model = language.fit(docs)
    predicted = language.predict(odd, model)
    assert predicted.count() == len(ODD)
    assert {r.doc_id for r in predicted.where("lang_pred = 'und'").collect()} == {1, 2, 3, 11}
    assert language.keep_known(odd, model).columns == odd.columns
    assert language.predict(empty, language.fit(empty)).count() == 0


def test_packing(spark, odd, empty):
    path = vocabulary("byte_bpe_50k.json")
    rows = packing.pack_documents(odd, path, pattern()).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        assert r.length == 2048 or r.piece == 0
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack_documents(empty, path, pattern()).count() == 0


def test_pieces_equal_a_plain_encoder(spark, documents):
    from tokenizers import Tokenizer

    plain, rows = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), run(spark, "op10")
    found, places = defaultdict(dict), defaultdict(list)
    for r in rows:
        found[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(found) == set(documents)
    for doc_id, text in documents.items():
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        expected, start = [], 0
        while start < len(ids):
            length = (len(ids) % 2048 or 2048) if not start else 2048
            expected.append((start, length, zlib.crc32(ids[start:start + length].tobytes())))
            start += length
        assert [found[doc_id][k] for k in range(len(found[doc_id]))] == expected
    for held in places.values():
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and held[0][0] == 0 and sum(held[-1]) <= 2048


def test_pieces_of_one_id_are_dealt_to_all_shards(spark):
    chance = np.random.RandomState(5)
    rows = [(1, 0, 0, int(n), 7) for n in chance.randint(600, 1100, 900)] + [(None, 0, 0, 2048, 7)] * 5
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    packed = packing.pack(near.stored(cut, "cut"), shard_pieces=100).collect()
    assert Counter((r.doc_id, r.length) for r in packed) == Counter((r[0], r[3]) for r in rows)
    fills, shards = defaultdict(int), Counter(r.sequence_id >> 24 for r in packed)
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills[r.sequence_id]
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 2048 and len(shards) == 10 and max(shards.values()) < 200


def test_another_pattern_is_followed():
    own = bpe.coder(vocabulary("byte_bpe_multi_50k.tiktoken"), r"[^\s]+|\s+")
    assert own.split("don't stop") == ["don't", " ", "stop"]
    assert bpe.coder(vocabulary("byte_bpe_multi_50k.tiktoken"), pattern()).split("don't stop") == ["don", "'t", " stop"]


def test_genetic_packing_keeps_every_item():
    sizes = np.random.RandomState(5).randint(200, 1400, 300).tolist()
    best = packing.evolve(sizes, 2048, [], 7)[0]
    assert sorted(i for b in best for i in b) == list(range(300))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in best)
    assert packing.lower_bound(sizes, 2048) <= len(best) <= len(packing.best_fit(sizes, 2048, [], list(range(300))))


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "personal_data", "packing"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_small_batches_from_any_frame(spark, stage):
    """A stage bounds what a task holds at once, also of rows that `read_table` did not read."""
    import corpus_pipeline

    def lengths(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([len(batch)])], ["n"])

    docs = spark.createDataFrame([(k, f"Some plain words of text {k}", "en", "s", 0) for k in range(40)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert spark.range(0, 5000, 1, 1).mapInArrow(lengths, "n long").agg(F.max("n")).first()[0] <= 1000


def test_line_dedup_carries_each_text_once(odd):
    """The rows that meet their deletions hold the text in `row` and nowhere else."""
    plan = lines.dedup_documents(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"MapInArrow run\((.*?)\)", plan)[1].replace(" ", "").count("#") == 2
    kept = lines.dedup_documents(odd.withColumn("removed", F.lit("x"))).collect()
    assert all(r.removed == "x" for r in kept) and len(kept) == lines.dedup_documents(odd).count()


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_by_union_find(spark, few):
    """A chain, a star with a null id and random links, by rounds alone and with the finish in one task."""
    from keepwell.llm.components import components

    draw = np.random.RandomState(3).randint(200, 400, (90, 2)).tolist()
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 50)] + [(a, b) for a, b in draw if a != b]
    up = {}

    def root(key):
        while up.setdefault(key, key) != key:
            key = up[key]
        return key

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    key = "struct<doc_id:long,version:long>"
    rows = spark.createDataFrame([((a or None, 1), (b, 1)) for a, b in links], f"a {key}, b {key}")
    found = {r.key.doc_id or 0: r.component.doc_id or 0 for r in components(rows, few).collect()}
    assert found == {k: root(k) for k in up}
    assert components(rows.limit(0), few).count() == 0
