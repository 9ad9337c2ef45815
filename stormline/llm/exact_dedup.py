"""Exact duplicates by distributed MSD radix partitioning; equality is decided by the bytes, not by a digest.

A group of documents is split by its next digit: the following bytes of the text. Documents alone in their group
are done, so are groups whose texts have ended, and only the rest go on. Digits widen from round to round
(32 bytes, 512, 8192, ...), so a text of n bytes takes O(log n) rounds. The first digit also holds the length,
so all texts of a group end together. A round counts each digit's documents before the shuffle, so a group of
any number of copies sends one row per task; the counts are written out and joined to the documents, always by
sorting, so that the plan and its shuffle keep their shape as the data grows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .url_filter import LOWER, UPPER

FIRST, WIDER = 32, 16


def normalised(text: str | Column) -> Column:
    """Lower-cases A-Z only; null is empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.encode(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "UTF-8")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST, wider: int = WIDER) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256), one row per input row.

    Of equal normalised texts the row with the largest id is kept; rows that share that id are all kept and all
    count in group_size. Null texts are empty texts. A row with a null id is never kept unless no row of its group
    has an id; then keep_id is null and kept is false. Other columns are ignored.
    """
    body = normalised(text_col)
    digit = F.col("digit")
    active = docs.select(F.col(id_col).alias("id"), body.alias("body")).select(
        "id", F.lit(None).cast("bigint").alias("gid"), F.octet_length("body").alias("size"), F.sha2("body", 256).alias("sha"), "body"
    )
    done, at, width = [], 1, first
    while True:
        keyed = active.withColumn("digit", F.substring("body", at, width))
        keys = ["gid", "size", "digit"]
        groups = keyed.select(*keys, "id").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep")).filter("n > 1")
        groups = materialise(groups.withColumn("next", F.monotonically_increasing_id()))
        same = groups.select(F.col("gid").alias("g"), F.col("size").alias("s"), F.col("digit").alias("d"), "n", "keep", "next")
        met = (F.col("gid").eqNullSafe(F.col("g"))) & (F.col("size") == F.col("s")) & (digit == F.col("d"))
        out = materialise(
            keyed.join(same.hint("merge"), met, "left").select(
                "id", F.col("next").alias("gid"), "size", "sha", F.coalesce("n", F.lit(1)).alias("n"),
                F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"),
                F.when(F.col("n").isNotNull() & (F.col("size") >= at + width), F.col("body")).alias("body"),
            )
        )
        done.append(out.filter("body IS NULL").select("id", "keep", "n", "sha"))
        active = out.filter("body IS NOT NULL").select("id", "gid", "size", "sha", "body")
        if active.isEmpty():
            break
        at, width = at + width, width * wider
    return reduce(DataFrame.unionByName, done).select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        F.coalesce(F.col("id") == F.col("keep"), F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256"),
    )
