"""Tumbling bins and regular grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK, HALO, Span, before, chunk_window, floor_to, micros, over_chunks, span_us, upto, with_context, with_value_bin
from .fill import carry, ffill


def floor_time(ts: str | Column, width: Span) -> Column:
    return F.timestamp_micros(floor_to(micros(ts), span_us(width)))


def ceil_time(ts: str | Column, width: Span) -> Column:
    size = span_us(width)
    return F.timestamp_micros(floor_to(micros(ts) + F.lit(size - 1), size))


def grid(
    bounds: DataFrame, *, keys: Sequence[str], ts: str, step: Span, start: str = "lo", end: str = "hi", index: str | None = None
) -> DataFrame:
    """All grid times from `start` to `end` (inclusive) per row of `bounds`, numbered from 0 as `index`.

    Times are made in two levels, blocks first, so that no row ever holds a whole series' times.
    """
    size = span_us(step)
    lo, hi = micros(start), micros(end)
    wide = F.lit(size * 1024).cast("long")
    blocks = bounds.select(*keys, lo.alias("_lo"), hi.alias("_hi")).filter("_lo <= _hi")
    blocks = blocks.withColumn("_from", F.explode(F.sequence(F.col("_lo"), F.col("_hi"), wide)))
    upper = F.least(F.col("_hi"), F.col("_from") + wide - F.lit(size))
    times = blocks.select(*keys, "_lo", F.explode(F.sequence(F.col("_from"), upper, F.lit(size).cast("long"))).alias("_u"))
    number = [F.expr(f"(_u - _lo) div {size}").alias(index)] if index else []
    return times.select(*keys, F.timestamp_micros("_u").alias(ts), *number)


def time_bounds(df: DataFrame, *, keys: Sequence[str], ts: str, step: Span, outer: bool = False) -> DataFrame:
    """First and last grid time per series; `outer` rounds the last one up instead of down."""
    last = ceil_time("hi", step) if outer else floor_time("hi", step)
    ends = df.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return ends.filter(F.col("lo").isNotNull()).select(*keys, floor_time("lo", step).alias("lo"), last.alias("hi"))


def hourly_grid(df: DataFrame, *, keys: Sequence[str], ts: str, step: Span = "1h", outer: bool = True) -> DataFrame:
    """Every grid time between a series' first and last row, rounded outwards."""
    return grid(time_bounds(df, keys=keys, ts=ts, step=step, outer=outer), keys=keys, ts=ts, step=step)


def on_grid(df: DataFrame, aggs: dict[str, Column], *, keys: Sequence[str], ts: str, step: Span, times: DataFrame) -> DataFrame:
    """Aggregate rows into bins and add the empty bins.

    Grid times join the bins as rows with no measures, so one shuffle makes both; `count` must be
    written over a measure, not over rows.
    """
    bins = df.withColumn("_bin", floor_time(ts, step)).drop(ts).withColumnRenamed("_bin", ts)
    return bins.unionByName(times, allowMissingColumns=True).groupBy(*keys, ts).agg(*[a.alias(n) for n, a in aggs.items()])


def resample(
    df: DataFrame, aggs: dict[str, Column], *, keys: Sequence[str], ts: str, step: Span = "1h", empty: bool = True
) -> DataFrame:
    """Tumbling bins labelled by their start; `empty` adds bins without rows between the first and last."""
    if not empty:
        return df.groupBy(*keys, floor_time(ts, step).alias(ts)).agg(*[a.alias(n) for n, a in aggs.items()])
    times = grid(time_bounds(df, keys=keys, ts=ts, step=step), keys=keys, ts=ts, step=step)
    return on_grid(df, aggs, keys=keys, ts=ts, step=step, times=times)


def resample_mean(df: DataFrame, cols: Sequence[str], **where) -> DataFrame:
    return resample(df, {c: F.avg(c) for c in cols}, **where)


def resample_sum_zero(df: DataFrame, cols: Sequence[str], **where) -> DataFrame:
    return resample(df, {c: F.coalesce(F.sum(c), F.lit(0.0)) for c in cols}, **where)


def resample_last(
    df: DataFrame, cols: Sequence[str], *, keys: Sequence[str], ts: str, step: Span = "1h", chunk: Span = "30d"
) -> DataFrame:
    """Forward-filled bins: each bin start takes the last row at or before it, NULLs in that row included.

    A bin start can only see the last row of the step before it, so rows are first reduced to one per
    step (combined on the map side); the grid and the carry work on that.
    """
    last = df.groupBy(*keys, ceil_time(ts, step).alias("_bin")).agg(
        F.max_by(F.struct(*cols), F.col(ts)).alias("_row"), F.min(ts).alias("lo"), F.max(ts).alias("hi")
    )
    ends = last.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo IS NOT NULL")
    ends = ends.select(*keys, floor_time("lo", step).alias("lo"), floor_time("hi", step).alias("hi"))
    times = grid(ends, keys=keys, ts=ts, step=step).withColumn("_side", F.lit(1))
    rows = last.select(*keys, F.col("_bin").alias(ts), F.lit(0).alias("_side"), "_row")
    held = carry(times.unionByName(rows, allowMissingColumns=True), keys=keys, ts=ts, forward={"_held": "_row"}, chunk=chunk, order=["_side"])
    return held.filter("_side = 1").select(*keys, ts, *[F.col(f"_held.{c}").alias(c) for c in cols])


def reindex_ffill(
    df: DataFrame, cols: Sequence[str], *, keys: Sequence[str], ts: str, step: Span = "1h", chunk: Span = "30d"
) -> DataFrame:
    """Rows that fall exactly on a grid time keep their values, all others vanish; then values are held."""
    exact = df.filter(micros(ts) == micros(floor_time(ts, step))).select(*keys, F.col(ts).cast("timestamp").alias(ts), *cols)
    times = hourly_grid(df, keys=keys, ts=ts, step=step)
    both = exact.unionByName(times, allowMissingColumns=True).groupBy(*keys, ts).agg(*[F.max(c).alias(c) for c in cols])
    return ffill(both, cols, keys=keys, ts=ts, chunk=chunk)


def minute_bucket(df: DataFrame, floats: Sequence[str], flags: Sequence[str], *, keys: Sequence[str], ts: str, order: Sequence[str] = ()) -> DataFrame:
    """Per minute: mean of the measures, last non-null value of the flags."""
    rank = F.struct(ts, *order)
    return df.groupBy(*keys, floor_time(ts, "1m").alias("minute")).agg(
        *[F.avg(c).alias(c) for c in floats],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in flags],
    )


def grouped_median(df: DataFrame, col: str, *, keys: Sequence[str], bins: int = 128) -> DataFrame:
    """Exact median per group, without holding a group's values in one task.

    Equal values are counted first; the values are cut into bins of about equally many distinct ones, counts run over
    the bins, and only the bins that hold a middle rank are looked into.
    """
    valid = df.filter(F.col(col).isNotNull())
    counts = valid.groupBy(*keys, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = with_value_bin(counts, "_v", bins)
    totals = counts.groupBy(*keys, CHUNK).agg(F.sum("_n").alias("_n"))
    context = totals.select(
        *keys, CHUNK,
        F.coalesce(F.sum("_n").over(before(over_chunks(keys))), F.lit(0).cast("long")).alias("_n"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"),
    )
    run = upto(chunk_window(keys, "_v"))
    ranked = with_context(counts, context).select(
        "*", F.sum("_n").over(run).alias("_upto"), F.first("_all", ignorenulls=True).over(run).alias("_total")
    ).filter(~F.col(HALO))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1

    def holds(rank: Column) -> Column:
        return (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)

    middle = ranked.groupBy(*keys).agg(F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_b"))
    return middle.select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(col))


def pivot_median(df: DataFrame, *, keys: Sequence[str], band: str, value: str, bands: Sequence[str]) -> DataFrame:
    """One column per band with the median of its rows; the bands are named, so no scan is spent on finding them."""
    medians = grouped_median(df.filter(F.col(band).isin(*bands)), value, keys=[*keys, band])
    return medians.groupBy(*keys).agg(*[F.max(F.when(F.col(band) == b, F.col(value))).alias(b) for b in bands])
