"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.llm import (
    bpe, decontamination, imatch, language, lines, near, packing, pii, ranking, recompression, suffixes, vantage, whitening)
from keepwell.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is. The operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("op1_vantage_point_search", """
with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every vec_id divisible by 20; factor 1, so the search is exact."""
    return vantage.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=1.0)


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_strings(read_table(spark, sf_dir, "documents")).drop("kept")


@query("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read_table(spark, sf_dir, "documents")).drop("kept")


@query("op6_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id of its class; `stays` marks the one that a filter would keep."""
    found = near.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("key.doc_id").alias("doc_id"), F.col("class_key.doc_id").alias("class_id"),
                        F.expr("key = class_key").alias("stays"))


@query("op4_recompression_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup_passages(read_table(spark, sf_dir, "documents")).drop("kept")


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


@query("op8_imatch_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return imatch.edited_fingerprints(docs, imatch.band(docs))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(training_rows(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), pattern())


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=4)


TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op12_ranked_search", f"""
with d as (select row_number() over () as row, doc_id, regexp_extract_all({LOWERED}, '{TERM}') as terms
  from documents where text is not null),
dn as (select row, doc_id, len(terms) as n from d where len(terms) > 0),
total as (select count(*) as docs, sum(n)::bigint as terms from dn),
dt as (select row, term, count(*) as tf from (select row, unnest(terms) as term from d) group by all),
q as (select item_id, term, count(*) as times from (
  select item_id, unnest(regexp_extract_all({LOWERED}, '{TERM}')) as term
  from (select distinct item_id, text from benchmark where text is not null)) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w
  from (select term, count(*) as df from dt group by term), total),
s as (select q.item_id, dn.doc_id, dn.row, sum(q.times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (
    100 - 75 + ((75 * n * docs) // total.terms)))))::bigint as score
  from q join w using (term) join dt using (term) join dn using (row), total group by all)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id nulls first) as rank from s where score > 0)
where rank <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


@query("op13_decontamination", f"""
with d as (select row_number() over () as row, doc_id, coalesce(regexp_extract_all({LOWERED}, '{TERM}'),
    []) as words from documents),
b as (select item_id, words from (select item_id, regexp_extract_all({LOWERED}, '{TERM}') as words
  from benchmark) where len(words) > 0),
w as (select distinct item_id, size, words[i : i + size - 1] as run from (
  select *, unnest(range(1, len(words) - size + 2)) as i from (select *, least(len(words), 10) as size from b))),
p as (select row, size, i, words[i : i + size - 1] as run from (
  select *, unnest(range(1, len(words) - size + 2)) as i from d, (select distinct size from w))),
m as (select p.row, p.size, p.i, w.item_id from p join w using (size, run)),
hit as (select row, count(*) as n_hit from (
  select distinct row, unnest(range(i, i + size)) as place from (select distinct row, size, i from m)) group by row),
items as (select row, count(*) as n_items, string_agg(item, ',' order by item) as names from (
  select distinct row, coalesce(item_id::varchar, '') as item from m) group by row)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (row) left join items using (row)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("longest")
