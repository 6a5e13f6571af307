"""A corpus pipeline of the operators in kindred.llm: toxicity, near-duplicates, repeated paragraphs, packing."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import packing, paragraphs, simhash, toxicity
from kindred.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of toxicity 0.3 or more.  Each row is judged by its own text; without labels of both kinds all rows stay."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, scorer, 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays: the smallest id, then text hash; rows without an id come last.

    Rows of equal id and text are copies; of those the first in the order of all columns stays.
    """
    groups = simhash.grouped(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    kept = groups.groupBy("root").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__key"))
    id_, key = F.col("doc_id").cast("long"), simhash.text_key()
    rows = docs.join(kept, id_.eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left_semi")
    one = rows.groupBy(id_.alias("__id"), key.alias("__key")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return one.select("row.*")


def drop_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out the words that an earlier document, or place, has in a paragraph alike; documents stay, with what is left of their text."""
    return paragraphs.remove(docs, paragraphs.repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_paragraphs),
    ("best_fit_packing", pack),
]

#: The linear classifier, the fingerprints and the packing are beyond SQL; a test holds each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    return functools.reduce(lambda d, stage: scratch.put(stage[1](spark, d, sf_dir)), STAGES, docs)
