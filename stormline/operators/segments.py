"""Runs, crossings, gaps and peaks along a series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
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
    floor_to,
    micros,
    over_chunks,
    upto,
    with_chunk,
    with_context,
)


def previous_row(
    df: DataFrame, cols: dict[str, str | Column], *, keys: Sequence[str], ts: str, chunk: Span = "30d", order: Sequence[str] = ()
) -> DataFrame:
    """New name -> expression on the preceding row (NULL on the first), with `_pos` numbered alongside."""
    rows = with_chunk(df, ts, chunk)
    whole = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])
    rows = rows.withColumn("_row", whole)
    rank = F.struct(US, *order) if order else F.col(US)
    edges = rows.groupBy(*keys, CHUNK).agg(F.max_by("_row", rank).alias("_row"), F.count(F.lit(1)).alias("_n"))
    over = over_chunks(keys)
    context = edges.select(
        *keys,
        CHUNK,
        F.lag("_row").over(over).alias("_row"),
        F.coalesce(F.sum("_n").over(before(over)), F.lit(0).cast("long")).alias("_skip"),
    )
    inside = chunk_window(keys, US, *order)
    step = F.when(F.col(HALO), F.col("_skip")).otherwise(F.lit(1).cast("long"))
    seen = with_context(rows, context).select(
        "*", F.lag("_row").over(inside).alias("_before"), (F.sum(step).over(upto(inside)) - 1).alias(POS)
    )
    kept = [c for c in df.columns if c not in cols]
    return seen.filter(~F.col(HALO)).select(*kept, *[F.col(f"_before.{n}").alias(n) for n in cols], POS)


def gap_hours(df: DataFrame, col: str, *, keys: Sequence[str], ts: str, chunk: Span = "30d") -> DataFrame:
    """Hours since the previous row with a value, 0 for the first; rows without a value are dropped."""
    valid = df.filter(F.col(col).isNotNull())
    seen = previous_row(valid, {"_was": micros(ts)}, keys=keys, ts=ts, chunk=chunk)
    hours = (micros(ts) - F.col("_was")) / F.lit(3_600_000_000)
    return seen.withColumn("gap_hours", F.coalesce(hours, F.lit(0.0))).drop("_was", POS)


def crossings(df: DataFrame, col: str, level: float, *, keys: Sequence[str], ts: str, chunk: Span = "30d") -> DataFrame:
    """Rows at or below the level whose preceding row was above it."""
    seen = previous_row(df, {"_was": col}, keys=keys, ts=ts, chunk=chunk)
    return seen.filter((F.col(col) <= level) & (F.col("_was") > level)).select(*df.columns)


def run_segments(
    df: DataFrame,
    state: Column,
    *,
    keys: Sequence[str],
    ts: str,
    chunk: Span = "30d",
    neighbours: bool = False,
) -> DataFrame:
    """Number the runs of equal state and say where each begins and ends.

    Adds `seg` (from 1), `seg_start` (time) and `seg_from` (row position) of its first row, `seg_len`
    (rows), `seg_next` (time of the first row after it, NULL for the last run) and `series_end`.  With
    `neighbours`, `state_before` and `state_after` are the states of the adjoining runs.
    """
    rows = with_chunk(df.withColumn("_state", state), ts, chunk)
    here, at = F.struct(F.col("_state").alias("s")), F.col(ts)
    plain = Window.partitionBy(*keys, CHUNK).orderBy(US)

    # first pass: what each chunk looks like on its own, with positions counted from its first row
    seen = rows.select(*keys, CHUNK, US, "_state", at.alias("_t"), F.lag(here).over(plain).alias("_was"), (F.row_number().over(plain) - 1).cast("long").alias("_p"))
    mark = F.struct(F.col("_p").alias("p"), F.col("_t").alias("t"), F.col("_was.s").alias("w"), F.col("_state").alias("s"))
    inner = F.when(F.col("_was").isNotNull() & ~F.col("_was.s").eqNullSafe(F.col("_state")), mark)
    summary = seen.withColumn("_turn", inner).groupBy(*keys, CHUNK).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("_turn").alias("_k"),
        F.min_by(here, US).alias("_head"),
        F.max_by(here, US).alias("_tail"),
        F.min("_t").alias("_t0"),
        F.max("_t").alias("_t1"),
        F.min_by("_turn", F.when(F.col("_turn").isNotNull(), F.col(US))).alias("_first"),
        F.max_by("_turn", F.when(F.col("_turn").isNotNull(), F.col(US))).alias("_last"),
    )

    # the table of chunks: does a chunk open with a turn, and what do its neighbours hand over
    along = over_chunks(keys)
    ahead, behind = before(along), before(over_chunks(keys, reverse=True))
    linked = summary.select("*", F.lag("_tail").over(along).alias("_seen"), F.coalesce(F.sum("_n").over(ahead), F.lit(0).cast("long")).alias("_skip"))
    opens = F.col("_seen").isNull() | ~F.col("_seen.s").eqNullSafe(F.col("_head.s"))

    def placed(m: str) -> Column:
        moved = F.struct((F.col(f"{m}.p") + F.col("_skip")).alias("p"), F.col(f"{m}.t").alias("t"), F.col(f"{m}.w").alias("w"), F.col(f"{m}.s").alias("s"))
        return F.when(F.col(m).isNotNull(), moved)

    edge = F.when(opens, F.struct(F.col("_skip").alias("p"), F.col("_t0").alias("t"), F.col("_seen.s").alias("w"), F.col("_head.s").alias("s")))
    linked = linked.select(
        *keys, CHUNK, "_n", "_seen", "_skip", "_t1", (F.col("_k") + opens.cast("long")).alias("_k"),
        F.coalesce(placed("_last"), edge).alias("_opened"), F.coalesce(edge, placed("_first")).alias("_closes"),
    )
    context = linked.select(
        *keys, CHUNK, "_seen", "_skip",
        F.coalesce(F.sum("_k").over(ahead), F.lit(0).cast("long")).alias("_k"),
        F.last("_opened", ignorenulls=True).over(ahead).alias("_opened"),
        F.last("_closes", ignorenulls=True).over(behind).alias("_closes"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
        F.max("_t1").over(Window.partitionBy(*keys)).alias("_end"),
    )

    # second pass: the same rows behind their context row
    up, down = chunk_window(keys, US), chunk_window(keys, US, reverse=True)
    both = with_context(rows, context)
    one = F.when(F.col(HALO), F.col("_skip")).otherwise(F.lit(1).cast("long"))
    both = both.select(
        "*", F.lag(F.coalesce("_seen", F.when(~F.col(HALO), here))).over(up).alias("_was"), (F.sum(one).over(upto(up)) - 1).alias(POS)
    )
    turned = ~F.col(HALO) & (F.col("_was").isNull() | ~F.col("_was.s").eqNullSafe(F.col("_state")))
    mark = F.struct(F.col(POS).alias("p"), at.alias("t"), F.col("_was.s").alias("w"), F.col("_state").alias("s"))
    both = both.withColumn("_turn", F.when(turned, mark))
    both = both.select(
        "*",
        F.sum(F.when(F.col(HALO), F.col("_k")).otherwise(F.col("_turn").isNotNull().cast("long"))).over(upto(up)).alias("seg"),
        F.last(F.coalesce("_turn", "_opened"), ignorenulls=True).over(upto(up)).alias("_open"),
        F.last(F.coalesce("_turn", "_closes"), ignorenulls=True).over(before(down)).alias("_close"),
        F.first("_total", ignorenulls=True).over(upto(up)).alias("_rows"),
        F.first("_end", ignorenulls=True).over(upto(up)).alias("series_end"),
    )
    extra = [F.col("_open.w").alias("state_before"), F.col("_close.s").alias("state_after")] if neighbours else []
    return both.filter(~F.col(HALO)).select(
        *df.columns,
        POS,
        "seg",
        F.col("_open.t").alias("seg_start"),
        F.col("_open.p").alias("seg_from"),
        (F.coalesce(F.col("_close.p"), F.col("_rows")) - F.col("_open.p")).alias("seg_len"),
        F.col("_close.t").alias("seg_next"),
        "series_end",
        *extra,
    )


def drop_long_missing(
    df: DataFrame, cols: Sequence[str], longest: int, *, keys: Sequence[str], ts: str, chunk: Span = "30d"
) -> DataFrame:
    """Remove runs of more than `longest` rows in which every channel is missing."""
    missing = F.coalesce(*cols).isNull()
    runs = run_segments(df.withColumn("_gone", missing), F.col("_gone"), keys=keys, ts=ts, chunk=chunk)
    return runs.filter(~(F.col("_gone") & (F.col("seg_len") > longest))).select(*df.columns)


def flag_intervals(
    df: DataFrame, flag: Column, *, keys: Sequence[str], ts: str, chunk: Span = "30d"
) -> DataFrame:
    """Intervals (start, end) in which the flag holds; the end is the first row after it, or the last row."""
    runs = run_segments(df.select(*keys, ts, flag.alias("_on")), F.col("_on"), keys=keys, ts=ts, chunk=chunk)
    opening = runs.filter(F.col("_on") & (F.col(POS) == F.col("seg_from")))
    return opening.select(*keys, F.col(ts).alias("start"), F.coalesce("seg_next", "series_end").alias("end"))


def local_peaks(
    df: DataFrame, col: str, *, keys: Sequence[str], ts: str, height: float | None = None, chunk: Span = "30d"
) -> DataFrame:
    """Rows at strict local maxima; a flat top counts once, at its middle row (lower of two)."""
    runs = run_segments(df, F.col(col), keys=keys, ts=ts, chunk=chunk, neighbours=True)
    top = (F.col("state_before") < F.col(col)) & (F.col("state_after") < F.col(col))
    middle = F.col(POS) == F.col("seg_from") + F.floor((F.col("seg_len") - 1) / 2)
    peaks = runs.filter(top & middle)
    if height is not None:
        peaks = peaks.filter(F.col(col) >= height)
    return peaks.select(*df.columns)


def missing_ranges(expected: DataFrame, present: DataFrame, day: str, *, keys: Sequence[str], chunk_days: int = 3650) -> DataFrame:
    """Consecutive expected days that are not present, as (start, end).

    Both sides meet in one shuffle by (series, chunk of days), which also serves the numbering of the
    days; only the pieces that touch a chunk's border are looked at again, at most two per chunk.
    """
    number = F.unix_date(day).cast("long")
    sides = expected.select(*keys, day, F.lit(False).alias("_in")).unionByName(present.select(*keys, day, F.lit(True).alias("_in")))
    placed = sides.withColumn(CHUNK, floor_to(number, chunk_days)).repartition(*keys, CHUNK)
    gone = placed.groupBy(*keys, CHUNK, day).agg(F.max("_in").alias("_in")).filter("NOT _in")
    along = Window.partitionBy(*keys, CHUNK).orderBy(day)
    pieces = (
        gone.withColumn("_run", number - F.row_number().over(along))
        .groupBy(*keys, CHUNK, "_run")
        .agg(F.min(day).alias("start"), F.max(day).alias("end"))
    )
    first, last = F.unix_date("start") == F.col(CHUNK), F.unix_date("end") == F.col(CHUNK) + (chunk_days - 1)
    pieces = pieces.withColumn("_slot", F.when(~(first | last), F.col("start")))
    beside = Window.partitionBy(*keys, "_slot").orderBy("start")
    apart = F.coalesce(F.datediff("start", F.lag("end").over(beside)) > 1, F.lit(True))
    joined = pieces.withColumn("_apart", apart.cast("int")).withColumn("_run", F.sum("_apart").over(beside))
    return joined.groupBy(*keys, "_slot", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*keys, "start", "end")


def prominent_peaks(
    df: DataFrame, col: str, *, keys: Sequence[str], ts: str, prominence: float, chunk: Span = "30d"
) -> DataFrame:
    """Local maxima that stand out by at least `prominence` on both sides.

    A peak of height h qualifies on its left when, walking left, the values fall to h - prominence
    before any exceeds h (or the series ends).  That holds exactly for h >= T, where passing a value
    x turns T into max(x, min(T, x + prominence)), and T starts at infinity.  Such a step is a clamp, and
    clamps compose to clamps, so a chunk is summed up by two numbers per side, the short list of
    chunks is composed in order, and no side ever needs rows beyond its own chunk.
    """
    inf = float("inf")
    head = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    value = df.select(*keys, ts, F.col(col).alias("_v"))
    rows = with_chunk(value, ts, chunk).select(*keys, CHUNK, US, F.col("_v").cast("double").alias("_v"))

    def clamps(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the clamp composed of the rows before it."""
        low, high = np.empty(len(values)), np.empty(len(values))
        lo, hi = -inf, inf
        for i, x in enumerate(values):
            low[i], high[i] = lo, hi
            if x == x:
                lo, hi = max(x, min(lo, x + prominence)), max(x, min(hi, x + prominence))
        return np.append(low, lo), np.append(high, hi)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(US)
        v = pdf["_v"].to_numpy(dtype=float)
        llo, lhi = clamps(v)
        rlo, rhi = clamps(v[::-1])
        out = pdf[[*keys, CHUNK, US]].copy()
        out["_llo"], out["_lhi"] = llo[:-1], lhi[:-1]
        out["_rlo"], out["_rhi"] = rlo[:-1][::-1], rhi[:-1][::-1]
        out = out[(v >= llo[:-1]) & (v >= rlo[:-1][::-1])]  # no entry can lower the bound below these
        ends = pdf[[*keys, CHUNK]].iloc[[0]].copy()
        ends["_llo"], ends["_lhi"], ends["_rlo"], ends["_rhi"] = llo[-1], lhi[-1], rlo[-1], rhi[-1]
        return pd.concat([out, ends], ignore_index=True)[[*keys, CHUNK, US, "_llo", "_lhi", "_rlo", "_rhi"]].astype({US: "Int64"})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        left, right, t = [], [], inf
        for lo, hi in zip(pdf["_llo"], pdf["_lhi"]):
            left.append(t)
            t = max(lo, min(t, hi))
        t = inf
        for lo, hi in zip(pdf["_rlo"][::-1], pdf["_rhi"][::-1]):
            right.append(t)
            t = max(lo, min(t, hi))
        out = pdf[[*keys, CHUNK]].copy()
        out["_tl"], out["_tr"] = left, right[::-1]
        return out

    sides = "_llo double, _lhi double, _rlo double, _rhi double"
    composed = rows.groupBy(*keys, CHUNK).applyInPandas(inside, f"{head}{CHUNK} long, {US} long, {sides}")
    entered = (
        composed.filter(F.col(US).isNull()).drop(US).groupBy(*keys).applyInPandas(across, f"{head}{CHUNK} long, _tl double, _tr double")
    )
    tops = with_chunk(local_peaks(df, col, keys=keys, ts=ts, chunk=chunk), ts, chunk)
    known = tops.join(composed.filter(F.col(US).isNotNull()), [*keys, CHUNK, US]).join(entered, [*keys, CHUNK])

    def reached(lo: str, hi: str, entry: str) -> Column:
        return F.col(col) >= F.greatest(F.col(lo), F.least(F.col(entry), F.col(hi)))

    return known.filter(reached("_llo", "_lhi", "_tl") & reached("_rlo", "_rhi", "_tr")).select(*df.columns)
