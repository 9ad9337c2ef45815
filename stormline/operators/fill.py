"""Carrying values along a series: forward / backward fill, as-of joins, bounded interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import (
    CHUNK,
    HALO,
    POS,
    US,
    Span,
    before,
    chunk_window,
    micros,
    over_chunks,
    positions,
    span_us,
    upto,
    with_chunk,
    with_context,
)


def carry(
    df: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    forward: dict[str, str] | None = None,
    backward: dict[str, str] | None = None,
    series: dict[str, tuple[str, str]] | None = None,
    chunk: Span = "30d",
    order: Sequence[str] = (),
) -> DataFrame:
    """Last non-null value so far (`forward`) and next non-null value (`backward`), new name -> column.

    `series` adds figures of the whole series, new name -> (column, "min" | "max" | "sum"); they ride
    on the same context rows, so no join back by series is needed.
    """
    forward, backward, series = forward or {}, backward or {}, series or {}
    merge = {"min": F.min, "max": F.max, "sum": F.sum}
    rows = with_chunk(df, ts, chunk)
    rank = F.struct(US, *order) if order else F.col(US)
    known = {**{f"_f_{n}": (c, F.max_by) for n, c in forward.items()}, **{f"_b_{n}": (c, F.min_by) for n, c in backward.items()}}
    per_chunk = rows.groupBy(*keys, CHUNK).agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(n) for n, (c, pick) in known.items()],
        *[merge[kind](c).alias(f"_s_{n}") for n, (c, kind) in series.items()],
    )
    ahead, behind = before(over_chunks(keys)), before(over_chunks(keys, reverse=True))
    context = per_chunk.select(
        *keys,
        CHUNK,
        *[F.last(f"_f_{n}", ignorenulls=True).over(ahead).alias(f"_f_{n}") for n in forward],
        *[F.last(f"_b_{n}", ignorenulls=True).over(behind).alias(f"_b_{n}") for n in backward],
        *[merge[kind](f"_s_{n}").over(Window.partitionBy(*keys)).alias(f"_s_{n}") for n, (_, kind) in series.items()],
    )
    up = upto(chunk_window(keys, US, *order))
    down = upto(chunk_window(keys, US, *order, reverse=True))
    joined = with_context(rows, context)
    filled = {
        **{
            n: F.last(F.coalesce(F.when(~F.col(HALO), F.col(c)), F.col(f"_f_{n}")), ignorenulls=True).over(up)
            for n, c in forward.items()
        },
        **{
            n: F.last(F.coalesce(F.when(~F.col(HALO), F.col(c)), F.col(f"_b_{n}")), ignorenulls=True).over(down)
            for n, c in backward.items()
        },
        **{n: F.first(f"_s_{n}", ignorenulls=True).over(up) for n in series},
    }
    # helper names keep a column usable as its own target while others still read it
    staged = joined.select("*", *[v.alias(f"_to_{n}") for n, v in filled.items()])
    kept = [c for c in df.columns if c not in filled]
    return staged.filter(~F.col(HALO)).select(*kept, *[F.col(f"_to_{n}").alias(n) for n in filled])


def ffill(df: DataFrame, cols: Sequence[str], *, keys: Sequence[str], ts: str, chunk: Span = "30d") -> DataFrame:
    return carry(df, keys=keys, ts=ts, forward={c: c for c in cols}, chunk=chunk).select(*df.columns)


def bfill(df: DataFrame, cols: Sequence[str], *, keys: Sequence[str], ts: str, chunk: Span = "30d") -> DataFrame:
    return carry(df, keys=keys, ts=ts, backward={c: c for c in cols}, chunk=chunk).select(*df.columns)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    right_ts: str | None = None,
    chunk: Span = "30d",
    how: str = "left",
    strict: bool = False,
) -> DataFrame:
    """Each left row with the last right row at or before it (before it when `strict`).

    Both sides are unioned and the right row is carried forward, so no pairs are formed and no
    nested-loop join is planned.  The right row is carried whole: a NULL inside it stays NULL.
    `right` must be unique per (keys, time).  `how="inner"` drops left rows with no match.
    """
    right_ts = right_ts or ts
    probe = left.withColumn("_side", F.lit(0 if strict else 1)).withColumn("_at", F.col(ts).cast("timestamp"))
    events = right.select(
        *keys,
        F.col(right_ts).cast("timestamp").alias("_at"),
        F.lit(1 if strict else 0).alias("_side"),
        F.struct(*cols).alias("_hit"),
    ).withColumn("_event", F.lit(True))
    both = probe.unionByName(events, allowMissingColumns=True)
    carried = carry(both, keys=keys, ts="_at", forward={"_hit": "_hit"}, chunk=chunk, order=["_side"])
    rows = carried.filter(F.col("_event").isNull())
    if how == "inner":
        rows = rows.filter(F.col("_hit").isNotNull())
    return rows.select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in cols])


def exact_then_ffill(
    grid: DataFrame,
    events: DataFrame,
    cols: dict[str, object],
    *,
    keys: Sequence[str],
    ts: str,
    chunk: Span = "30d",
) -> DataFrame:
    """Events that fall exactly on a grid time set the value, which then holds; `cols` gives the default.

    Unlike `asof_join`, an event between grid times is never seen.
    """
    at_grid = events.select(*keys, ts, *cols).withColumn("_grid", F.lit(None).cast("boolean"))
    extra = [c for c in grid.columns if c not in keys and c != ts]
    both = grid.withColumn("_grid", F.lit(True)).unionByName(at_grid, allowMissingColumns=True)
    merged = both.groupBy(*keys, ts).agg(
        *[F.max(c).alias(c) for c in [*extra, *cols]], F.max("_grid").alias("_grid")
    )
    aligned = merged.filter(F.col("_grid")).drop("_grid")
    held = ffill(aligned, list(cols), keys=keys, ts=ts, chunk=chunk)
    return held.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in cols.items()})


def interpolate_both(
    df: DataFrame,
    col: str,
    *,
    keys: Sequence[str],
    ts: str,
    limit: int,
    chunk: Span = "30d",
    step: Span | None = None,
    close: bool = False,
) -> DataFrame:
    """Time-linear interpolation reaching `limit` rows into a gap from each side.

    A gap longer than twice the limit keeps a NULL core; before the first and after the last value
    the nearest value is held for `limit` rows.  `step` says that the rows lie on a regular grid, so
    row distances follow from the times.  `close=True` goes on with the unlimited forward fill,
    backward fill and 0 that leave no NULL.
    """
    us = micros(ts)
    rows = df.withColumn(POS, F.floor(us / F.lit(span_us(step))).cast("long")) if step else positions(
        df, keys=keys, ts=ts, chunk=chunk
    )
    # three plain columns rather than one struct: their last values combine in a hash aggregate
    seen = F.col(col).isNotNull()
    rows = rows.withColumns({"_v": F.col(col), "_u": F.when(seen, us), "_p": F.when(seen, F.col(POS))})
    parts = ("v", "u", "p")
    rows = carry(
        rows, keys=keys, ts=ts, chunk=chunk, forward={f"_p{c}": f"_{c}" for c in parts}, backward={f"_n{c}": f"_{c}" for c in parts}
    )
    near_prev, near_next = F.col(POS) - F.col("_pp") <= limit, F.col("_np") - F.col(POS) <= limit
    slope = (F.col("_nv") - F.col("_pv")) / (F.col("_nu") - F.col("_pu"))

    def on_line(at: Column) -> Column:
        return F.col("_pv") + slope * (at - F.col("_pu"))

    has_both = F.col("_pp").isNotNull() & F.col("_np").isNotNull()
    value = (
        F.when(F.col(col).isNotNull(), F.col(col))
        .when(has_both & (near_prev | near_next), on_line(us))
        .when(F.col("_np").isNull() & near_prev, F.col("_pv"))
        .when(F.col("_pp").isNull() & near_next, F.col("_nv"))
    )
    if close and step:
        # a gap core takes the last interpolated value before it, `limit` steps into the gap
        held = on_line(F.col("_pu") + F.lit(limit * span_us(step)))
        value = F.coalesce(value, F.when(has_both, held), F.col("_pv"), F.col("_nv"), F.lit(0.0))
    elif close:
        rows = carry(rows.withColumn("_filled", value), keys=keys, ts=ts, forward={"_held": "_filled"}, chunk=chunk)
        value = F.coalesce(F.col("_held"), F.col("_nv"), F.lit(0.0))
    return rows.select(*[value.alias(c) if c == col else F.col(c) for c in df.columns])
