"""A training corpus from raw documents: quality, repeated lines, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormline.llm import decontam, line_dedup, packing, quality, sketches
from stormline.llm.queries import table, tokenizer
from stormline.session import materialise, prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learnt from the labels, rejects."""
    return quality.keep(docs.select(*COLUMNS), quality.learn(docs, table(spark, sf_dir, "labels")))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated runs of lines; n_chars follows the text."""
    out = line_dedup.remove_repeated_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays; repeated rows stay once.

    Documents without an id cannot be told apart and all stay.
    """
    groups = sketches.near_duplicates(docs, k=NEAR_WORDS, similarity=NEAR_SIMILARITY)
    ids = materialise(groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("n")))
    copies = materialise(ids.filter("doc_id <> component").select("doc_id"))
    kept = docs.join(copies.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)  # one plan at every size
    if ids.filter("n > 1").isEmpty():
        return kept
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage like a benchmark item."""
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs, **tokenizer(), ids=True)


STAGES = [("quality", keep_quality), ("line_dedup", cut_lines), ("near_dedup", keep_one), ("decontamination", drop_leaks), ("packing", pack_tokens)]

ORACLE_SQL = None  # a learnt classifier, XXH64 fingerprints and a tokenizer are beyond SQL; tests/llm holds the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(prepare(spark), sf_dir, "documents")
    *first, (_, last) = STAGES
    docs = functools.reduce(lambda d, stage: materialise(stage[1](spark, d, sf_dir)), first, docs)
    return last(spark, docs, sf_dir)
