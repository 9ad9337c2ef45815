"""The hourly refresh: batch forms of each step, and their Structured Streaming forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stormline.operators.chunks import Span, floor_to, micros, span_us
from stormline.operators.resample import grid
from stormline.operators.sets import latest_row
from stormline.operators.upsert import dedupe_last, upsert_replace

FILL_TAG = "forward_fill"


def tail_cutoff(as_of: str, days: int = 2):
    """Noon of the day `days` days before `as_of`."""
    noon = F.date_trunc("day", F.lit(as_of).cast("timestamp")) + F.make_dt_interval(F.lit(0), F.lit(12))
    return noon - F.make_dt_interval(F.lit(days))


def rewrite_tail(stored: DataFrame, fresh: DataFrame, *, keys: Sequence[str], ts: str, as_of: str, days: int = 2) -> DataFrame:
    """Late data: everything stored since the cutoff is dropped and taken from the fresh rows."""
    cutoff = tail_cutoff(as_of, days).cast(stored.schema[ts].dataType)
    kept = stored.filter(F.col(ts) < cutoff)
    return upsert_replace(kept, fresh.filter(F.col(ts) >= cutoff), [*keys, ts])


def resume_point(stored: DataFrame, *, keys: Sequence[str], ts: str, start: str, days: int = 2) -> DataFrame:
    """First day to fetch per series: `days` before its last row, but not before `start`."""
    last = stored.groupBy(*keys).agg(F.max(ts).alias("_last"))
    back = (F.col("_last").cast("timestamp") - F.make_dt_interval(F.lit(days))).cast("date")
    return last.select(*keys, F.greatest(F.lit(start).cast("date"), back).alias("resume"))


def extend_to_now(df: DataFrame, *, keys: Sequence[str], ts: str, as_of: str, step: Span = "1h", tag: str = "source_type") -> DataFrame:
    """Repeat each series' last row on the steps after it up to `as_of`, tagged as filled."""
    rest = [c for c in df.columns if c not in (*keys, ts, tag)]
    end = F.timestamp_micros(floor_to(micros(F.lit(as_of)), span_us(step)))
    last = latest_row(df.select(*keys, ts, *rest), keys=keys, order=[ts])
    after = F.timestamp_micros(micros(ts) + F.lit(span_us(step)))
    ends = last.select(*keys, F.struct(*rest).alias("_row"), after.alias("lo"), end.alias("hi"))
    steps = grid(ends, keys=[*keys, "_row"], ts="_at", step=step)
    filled = steps.select(*keys, F.col("_at").cast(df.schema[ts].dataType).alias(ts), F.col("_row.*"), F.lit(FILL_TAG).alias(tag))
    return df.unionByName(filled)


def clear_fills(df: DataFrame, tag: str = "source_type") -> DataFrame:
    return df.filter(F.col(tag).isNull() | (F.col(tag) != FILL_TAG))


def retain(df: DataFrame, ts: str, as_of: str, hours: int) -> DataFrame:
    """Rows of the last `hours` hours; the bound is in the column's type, so it reaches the scan."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))
    return df.filter(F.col(ts) >= cutoff.cast(df.schema[ts].dataType))


def hourly_stream(stream: DataFrame, *, keys: Sequence[str], ts: str, value: str, late: str = "2 days") -> DataFrame:
    """Hourly means that are emitted once no row within the lateness bound can change them."""
    hours = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, "1 hour").alias("_w"))
    return hours.agg(F.avg(value).alias(value)).select(*keys, F.col("_w.start").alias(ts), value)


def last_value_stream(stream: DataFrame, *, key: str | Sequence[str], ts: str, value: str) -> DataFrame:
    """Newest value per series as a stream of changes; state is one row per series, combined before the shuffle.

    Write it in update mode. Of several rows with the newest time the one with the largest value counts.
    """
    keys = [key] if isinstance(key, str) else list(key)
    v = F.col(value).cast("double").alias("v")
    best = stream.groupBy(*keys).agg(F.max(F.struct(F.col(ts).alias("t"), v)).alias("_best"))
    return best.select(*keys, F.col("_best.t").cast("timestamp").alias(ts), F.col("_best.v").alias(value))


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """Upsert each micro-batch into a table kept as one folder per batch.

    A batch rewrites only its own folder, so a retried batch changes nothing; `read_upserts` resolves
    the folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        reduced = dedupe_last(batch, keys, order)
        reduced.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserts(spark, path: str, keys: Sequence[str]) -> DataFrame:
    """The table's current rows: per key the row of the latest batch."""
    return dedupe_last(spark.read.option("basePath", path).parquet(path), keys, ["batch"]).drop("batch")


def compact_upserts(spark, path: str, target: str, keys: Sequence[str]) -> None:
    """Fold a table's batch folders into a single one below `target`, numbered like the last of them."""
    newest = spark.read.option("basePath", path).parquet(path).agg(F.max("batch")).head()[0]
    read_upserts(spark, path, keys).write.mode("overwrite").parquet(f"{target}/batch={newest:012d}")
