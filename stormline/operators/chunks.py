"""Order-dependent work on series of any length, without one task per series.

A window with `partitionBy(key)` puts a whole series into one task, so a single hot key
decides the run time.  Here every series is cut into chunks of a fixed time width (or a fixed
number of rows) and windows are partitioned by `(keys, chunk)`:

* frames of bounded reach get *halo* rows: a row is also sent to each later (earlier) chunk whose
  frames can still see it, and is dropped again after the window;
* frames of unbounded reach get one *context* row per chunk: a summary per chunk (map-side
  combined), a running value over the short table of chunks, and that value unioned in front of
  the chunk's rows.

Both forms shuffle the rows once and never join them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

US, CHUNK, HALO, POS = "_us", "_chunk", "_halo", "_pos"

_UNIT = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}

Span = str | int | timedelta


def span_us(span: Span) -> int:
    """`"6h"`, `"4d"`, a timedelta or plain microseconds -> microseconds."""
    if isinstance(span, timedelta):
        return int(span.total_seconds() * 1_000_000)
    if isinstance(span, int):
        return span
    match = re.fullmatch(r"(\d+)(us|ms|s|m|h|d)", span.strip())
    if not match:
        raise ValueError(f"not a time span: {span!r}")
    return int(match[1]) * _UNIT[match[2]]


def micros(ts: str | Column) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def floor_to(value: Column, width: int) -> Column:
    """Largest multiple of `width` not above `value`; exact for times before 1970 too."""
    return value - F.pmod(value, F.lit(width).cast("long"))


def with_chunk(df: DataFrame, ts: str, chunk: Span) -> DataFrame:
    """Add `_us` and `_chunk` (the start of the row's chunk, in microseconds)."""
    return df.withColumn(US, micros(ts)).withColumn(CHUNK, floor_to(F.col(US), span_us(chunk)))


def balanced_chunk(df: DataFrame, *, keys: Sequence[str], ts: str, rows: int = 2_000_000) -> int:
    """A chunk width (microseconds) at which the busiest chunk of the busiest series holds about `rows` rows.

    Counts rows per series and hour, and only if an hour is already too full per minute and second.
    Use it for raw feeds of unknown rate; on an hourly grid the default widths are bounded as they are.
    """
    for unit in ("h", "m", "s"):
        width = _UNIT[unit]
        per = with_chunk(df, ts, width).groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("n"))
        most = per.agg(F.max("n")).head()[0] or 0
        if most <= rows:
            return width * max(1, min(rows // max(most, 1), 24 * 3650 * (_UNIT["h"] // width)))
    return _UNIT["s"]


def with_halo(df: DataFrame, order: str, width: int, back: int, ahead: int = 0) -> DataFrame:
    """Send each row to its own chunk and to every chunk whose frames reach it."""
    value = F.col(order)
    own = floor_to(value, width)
    first = floor_to(value - F.lit(ahead), width) if ahead else own
    last = floor_to(value + F.lit(back), width) if back else own
    spread = df.withColumn(CHUNK, F.explode(F.sequence(first, last, F.lit(width).cast("long"))))
    return spread.withColumn(HALO, F.col(CHUNK) != own)


def drop_halo(df: DataFrame, *more: str) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(US, CHUNK, HALO, *more)


def with_context(rows: DataFrame, context: DataFrame) -> DataFrame:
    """Put each chunk's context row among its rows; it carries `_halo = true` and sorts first."""
    return rows.withColumn(HALO, F.lit(False)).unionByName(
        context.withColumn(HALO, F.lit(True)), allowMissingColumns=True
    )


def chunk_window(keys: Sequence[str], *order: str | Column, reverse: bool = False) -> WindowSpec:
    """Window inside a chunk; the context row comes first in either direction of travel."""
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    ranked = [c.desc() for c in columns] if reverse else columns
    return Window.partitionBy(*keys, CHUNK).orderBy(F.col(HALO).desc(), *ranked)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def upto(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def over_chunks(keys: Sequence[str], reverse: bool = False) -> WindowSpec:
    """Window over the table of chunks: one row per (series, chunk), so its length is a time span."""
    order = F.col(CHUNK).desc() if reverse else F.col(CHUNK)
    return Window.partitionBy(*keys).orderBy(order)


def with_value_bin(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Adds `_chunk`, the number of the value's bin (0 .. bins); bins hold about equally many rows, whatever their spread.

    The bounds are approximate quantiles, one short array; each value is compared with them.
    """
    steps = F.array(*[F.lit(i / bins) for i in range(1, bins)] or [F.lit(0.5)])
    bounds = df.agg(F.percentile_approx(col, steps, F.lit(20 * bins)).alias("b")).scalar()
    below = F.size(F.filter("_bounds", lambda b: b < F.col(col)))
    return df.withColumn("_bounds", bounds).withColumn(CHUNK, F.coalesce(below, F.lit(0)).cast("long")).drop("_bounds")


def positions(
    df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span, order: Sequence[str] = ()
) -> DataFrame:
    """Add `_pos`: the 0-based row number within the series, numbered chunk by chunk."""
    rows = with_chunk(df, ts, chunk)
    counts = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    context = counts.select(
        *keys, CHUNK, F.coalesce(F.sum("_n").over(before(over_chunks(keys))), F.lit(0).cast("long")).alias("_skip")
    )
    step = F.when(F.col(HALO), F.col("_skip")).otherwise(F.lit(1).cast("long"))
    numbered = with_context(rows, context).withColumn(
        POS, F.sum(step).over(upto(chunk_window(keys, US, *order))) - 1
    )
    return drop_halo(numbered, "_skip")
