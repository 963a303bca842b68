"""The corpus pipeline: stages over documents, each stored before the next reads it.

toxicity        documents with a toxicity score of 0.7 or more go
quality_rules   documents that fail the base rules or lie outside the perplexity band go
simhash         one document of each group of near-duplicates stays
mixing          sources are brought to their target weights; documents may be cut or repeat
bpe             token ids of what is left
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tannin.llm import bpe, mixing, quality, simhash, toxicity
from tannin.llm.queries import TOKENIZER, table
from tannin.sources import sinks


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.7, with their columns.

    Null and empty texts have no toxic words and stay, as do null ids.  Repeated rows are
    scored alike.  Without labels of both kinds nothing is learned: all scores are one.
    """
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and lie within their language's band.

    Null and empty texts have too few words and go.  A null language is one of its own.
    Repeated rows share their fate.
    """
    return quality.good_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest doc_id, null ids last.

    Null, empty and white texts are one group.  Of rows with one doc_id the smallest hash
    of a text decides, of equal rows one stays.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; one is cut short or repeated where its quota says so.

    A null source is one of its own.  Documents without words are never taken.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; null and empty texts have none."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL can express a fitted field, a hashed fingerprint or a merge list.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = sinks.scratch_path(spark, f"pipeline-{name}")
        sinks.write_table(stage(spark, docs, sf_dir), path, fmt="parquet")
        docs = spark.read.parquet(path)
    return docs
