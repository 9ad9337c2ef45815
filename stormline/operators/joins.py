"""Merging feature frames by time, and pivoting horizons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def prefix_columns(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys])


def merge_features(frames: dict[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """Inner merge of several feeds on their time; every feed's columns get its name as prefix.

    All joins have the same key, so after the first exchange of each side Spark keeps the
    partitioning through the chain.  Feeds that are merged again and again go through `write_bucketed`
    and `merge_bucketed`.
    """
    named = [prefix_columns(df, name, on) for name, df in frames.items()]
    return reduce(lambda a, b: a.join(b, list(on), "inner"), named)


def write_bucketed(df: DataFrame, table: str, on: Sequence[str], buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Save a frame as a catalogue table bucketed and sorted by the merge key, and return it as read back.

    The rows are dealt by the key first, with the hash that buckets use, so each bucket is one file, sorted as a whole.
    Tables that are to be merged need equal keys and numbers of buckets (default: the session's shuffle partitions).
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, *on).sortWithinPartitions(*on)
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *on).sortBy(*on)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def merge_bucketed(tables: dict[str, str], on: Sequence[str], spark: SparkSession) -> DataFrame:
    """`merge_features` over tables of `write_bucketed`: merge joins along the buckets, without an exchange or a sort."""
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket is one sorted file
    named = [prefix_columns(spark.table(table), name, on) for name, table in tables.items()]
    return reduce(lambda a, b: a.join(b.hint("merge"), list(on), "inner"), named)


def join_labels(features: DataFrame, labels: DataFrame, *, keys: Sequence[str], ts: str, floor: str | None = None) -> DataFrame:
    """Features with their labels; `floor="hour"` matches on the hour of each side's time."""
    if floor:
        kind = features.schema[ts].dataType
        features = features.withColumn(ts, F.date_trunc(floor, ts).cast(kind))
        labels = labels.withColumn(ts, F.date_trunc(floor, ts).cast(kind))
    return features.join(labels, [*keys, ts], "inner")


def outer_join_hour(a: DataFrame, b: DataFrame, on: Sequence[str], zero_suffix: str = "_source_id") -> DataFrame:
    """Full outer join of two feature groups; provenance codes are 0 where a group has no row."""
    joined = a.join(b, list(on), "full")
    codes = [c for c in joined.columns if c.endswith(zero_suffix)]
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in codes})


def common_rows(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `a` whose time exists in `b`."""
    return a.join(b.select(*on).distinct(), list(on), "left_semi")


def pivot_horizons(long: DataFrame, *, on: Sequence[str], horizon: str, value: str, horizons: Sequence[int], prefix: str = "p_h", complete: bool = False) -> DataFrame:
    """One column per horizon from long predictions: an outer merge in one aggregation.

    With `complete`, times that lack a horizon are dropped, as an inner merge would.
    """
    wide = long.groupBy(*on).agg(*[F.max(F.when(F.col(horizon) == h, F.col(value))).alias(f"{prefix}{h}") for h in horizons])
    return wide.dropna("any", subset=[f"{prefix}{h}" for h in horizons]) if complete else wide


def cumulative_probability(cols: Sequence[str]) -> Column:
    """1 - product of (1 - p); a missing p counts as 0."""
    return F.lit(1.0) - reduce(lambda a, b: a * b, [F.lit(1.0) - F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
