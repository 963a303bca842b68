"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tannin import ship
from tannin.llm import (
    bpe, filter_audit, lexical, mixing, nearest, pitman_yor, pu_quality, quality, simhash, token_counts,
    token_store, toxicity, url_filter,
)
from tannin.llm.words import LOWER, UPPER, WORD

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)  # the operators' functions run in workers that may not have the package
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.write_list(rules))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    tagger = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    tagged = toxicity.tag(documents, tagger, ["doc_id"])
    return tagged.select(
        "_row.doc_id", toxicity.in_fold(F.col("_row.doc_id"), 3).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"), "spans")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), ["doc_id", "lang"])
    return judged.select("_row.doc_id", *quality.COUNTS, "base_failed", "kept", "log_perplexity")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return mixed.select("_row.doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_store.write_store(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    read = token_store.read_store(files)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    decoded = bpe.encode(documents, public_tokenizers.path(TOKENIZER), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = pu_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "_row.doc_id", pu_quality.in_fold(F.col("_row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= pu_quality.THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_nearest": op3_nearest,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_token_store": op8_token_store,
    "op9_token_counts": op9_token_counts,
    "op10_bpe": op10_bpe,
    "op11_lexical_search": op11_lexical_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_quality_classifier": op13_quality_classifier,
}

_FITS = "\n".join(
    f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'"
    for h, p, _ in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1])))
_BLOCKED = ", ".join(f"'{h}{p}'" for h, p, v in URL_RULES if v == "block")

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": f"""
        with rest as (
            select page_id, case when strpos(url, '://') > 0
                then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        parts as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as host from rest),
        cut as (
            select page_id, translate(host, '{UPPER}', '{LOWER}') as host,
                regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') as path from parts),
        ruled as (select *, case {_FITS} end as rule from cut)
        select *, case when rule in ({_BLOCKED}) then 'block' else 'allow' end as verdict from ruled""",
    "op11_lexical_search": f"""
        with listed as (
          select doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
              '{lexical.TERM}') as terms from documents where text is not null),
        sized as (select row_number() over () as row, doc_id, terms, len(terms) as n from listed where len(terms) > 0),
        total as (select count(*) as docs, sum(n)::bigint as terms from sized),
        asked as (select row_number() over () as query, item_id, list_distinct(regexp_extract_all(
              translate(text, '{UPPER}', '{LOWER}'),
              '{lexical.TERM}')) as terms from benchmark where text is not null),
        query_terms as (select query, item_id, unnest(terms) as term from asked),
        vocabulary as (select distinct term from query_terms),
        counted as (select row, term, count(*) as tf from (select row, unnest(terms) as term from sized)
              semi join vocabulary using (term) group by row, term),
        weighed as (select term, cast(floor(1000 * ln((2e0 * any_value(docs) + 2) / (2e0 * count(*) + 1))) as bigint) as w
              from counted cross join total group by term),
        spans as (select row, doc_id, 50 + (50 * n * docs) // total.terms as m from sized cross join total),
        scored as (select query, any_value(item_id) as item_id, any_value(doc_id) as doc_id,
              cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
              from query_terms join counted using (term) join weighed using (term) join spans using (row) group by query, row)
        select item_id, cast(row_number() over (partition by query order by score desc, doc_id nulls last) as integer) as rank,
              doc_id, score from scored where score > 0
        qualify rank <= 50""",
    "op12_filter_audit": f"""
        with base as (
          select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
                 regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents),
        smallest as (select text, min(doc_id) as least from base group by text),
        labelled as (select doc_id, max(case when quality = 1 then 1 else 0 end) as quality,
                            max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
        marked as (
          select part, coalesce(quality, 0) as quality, coalesce(toxic, 0) as toxic,
                 [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
                  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
                  regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] as fails
          from base join smallest using (text) left join labelled using (doc_id)),
        grouped as (select part, fails, count(*) as n, sum(quality) as good, sum(toxic) as toxic from marked group by part, fails),
        letters as (select unnest(range(5)) as i),
        orders as (
          select [a.i, b.i, c.i, d.i, e.i] as places from letters a, letters b, letters c, letters d, letters e
          where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        steps as (select places, list_aggregate(list_transform(places, lambda p: substr('ABCDE', p + 1, 1)), 'string_agg', '')
                      as filter_order, step, places[step] as own, places[:step - 1] as before
                  from orders cross join range(1, 6) s(step)),
        counted as (
          select part, filter_order, cast(step as integer) as step, own,
                 coalesce(sum(n) filter (where not gone and not fails[own + 1]), 0)::bigint as kept,
                 coalesce(sum(n) filter (where not gone and fails[own + 1]), 0)::bigint as removed,
                 coalesce(sum(n) filter (where gone and fails[own + 1]), 0)::bigint as redundant,
                 coalesce(sum(n) filter (where fails[own + 1]
                     and len(list_filter(fails, lambda f: f)) = 1), 0)::bigint as unique_fails,
                 coalesce(sum(good) filter (where not gone and fails[own + 1]), 0)::bigint as good_lost,
                 coalesce(sum(toxic) filter (where not gone and fails[own + 1]), 0)::bigint as toxic_lost
          from (select *, len(list_filter(before, lambda p: fails[p + 1])) > 0 as gone from grouped cross join steps)
          group by part, filter_order, step, own)
        select * exclude (own), cast(sum(removed) over (partition by part, own) as bigint) as shapley from counted""",
}
