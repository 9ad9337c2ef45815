"""Unions, intersections and differences of time indexes, and small row selections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_times(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    return a.select(*cols).union(b.select(*cols)).distinct()


def intersect_times(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    return a.select(*cols).intersect(b.select(*cols))


def except_times(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    return a.select(*cols).subtract(b.select(*cols))


def latest_n(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The last `n` rows of each series (of the frame, without keys); each task keeps only its own best `n` of a series."""
    newest = [F.col(o).desc() for o in order]
    if not keys:
        return df.orderBy(*newest).limit(n)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def preferred(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """The rows of the first value in `order` that has any, else of the least value there is."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(o) for o in order]), F.col(col)).cast("int"), F.lit(0))
    best = df.agg(F.min(F.struct(F.when(rank > 0, rank).otherwise(len(order) + 1).alias("r"), F.col(col).alias("v"))).alias("best")).scalar()
    return df.filter(F.col(col) == best["v"])


def latest_row(df: DataFrame, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
