"""The input frames of the catalogue, derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stormline.operators.chunks import micros
from stormline.operators.resample import grid, on_grid, resample, time_bounds

HOUR = 3_600_000_000


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def keyed(spark, sf_dir) -> DataFrame:
    """Raw events as a keyed series: k, ts (instant), event_id, v, props."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("k"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("v"), "props"
    )


def hourly(spark, sf_dir) -> DataFrame:
    return resample(keyed(spark, sf_dir), {"v": F.avg("v"), "n": F.count("v")}, keys=["k"], ts="ts", empty=False)


def gridded(spark, sf_dir) -> DataFrame:
    """Hourly frame on its full grid with gaps of every length class; `i` is the hour index."""
    raw = keyed(spark, sf_dir).select("k", "ts", "v")
    bounds = time_bounds(raw, keys=["k"], ts="ts", step="1h")
    times = grid(bounds, keys=["k"], ts="ts", step="1h", index="i")
    full = on_grid(raw, {"v": F.avg("v"), "i": F.max("i")}, keys=["k"], ts="ts", step="1h", times=times)
    i = F.col("i")
    gap = (i % 24).isin(5, 6) | (i % 100).between(40, 46) | i.between(300, 315)
    return full.select("k", "ts", "i", F.when(~gap, F.col("v")).alias("v"))


def feed(spark, sf_dir, kind: str) -> DataFrame:
    return gridded(spark, sf_dir).filter(F.col("k") == kind).select("ts", "v")


def wide(spark, sf_dir) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    hour = keyed(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    flat = hour.groupBy("ts").agg(*[F.avg(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in kinds])
    by, bz, bx = F.col("click") - 50, F.col("error") - 50, F.col("signup") - 50
    return flat.select(
        "ts", *kinds, by.alias("by"), bz.alias("bz"), bx.alias("bx"), (300 + 5 * F.col("view")).alias("speed"),
        (F.col("purchase") / 10).alias("density"), F.sqrt(bx * bx + by * by + bz * bz).alias("bt"),
    )


def dst(spark, sf_dir) -> DataFrame:
    return wide(spark, sf_dir).filter("error IS NOT NULL").select("ts", (60 - 2 * F.col("error")).alias("dst"))


def kp(spark, sf_dir) -> DataFrame:
    level = F.round(F.least(F.lit(9.0), F.col("view") / 10) * 3) / 3
    return wide(spark, sf_dir).filter("view IS NOT NULL").select("ts", level.alias("kp"))


def catalogue(spark, sf_dir) -> DataFrame:
    width = 3.6 * F.get_json_object("props", "$.k").cast("double")
    return (
        keyed(spark, sf_dir)
        .filter("k = 'purchase'")
        .select(
            "event_id", "ts", (200 + 10 * F.col("v")).alias("median_velocity"), width.alias("angular_width"),
            ((F.col("event_id") * 37) % 360).cast("double").alias("position_angle"), F.col("v").alias("velocity_variation"),
        )
    )


def daily(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderdate").cast("timestamp").alias("ts")).agg((F.avg("o_totalprice") / 100).alias("v"))


def scored(spark, sf_dir) -> DataFrame:
    """doc_id, y (0/1), p in (0, 1)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = (F.col("n_chars") % 997 + 1) / F.lit(999.0)
    return docs.select("doc_id", p.alias("p")).join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id").select("doc_id", "y", "p")


def r6(value: str | Column) -> Column:
    """Six decimals, rounded as the SQL texts round (see registry.r6)."""
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(3.7e-10), 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def hours_between(later: str, earlier: str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(HOUR)
