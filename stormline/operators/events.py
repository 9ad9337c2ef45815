"""Storm onsets, spacing, interval labels and merged storm intervals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK, HALO, US, Span, before, chunk_window, floor_to, micros, over_chunks, span_us, with_chunk, with_context
from .fill import carry
from .segments import previous_row

HOUR_US = 3_600_000_000


def _marks(df: DataFrame, index: str, storm: Column, *, keys, ts, chunk, whole: bool) -> DataFrame:
    """Downward zero crossings of `index` and first rows of storm runs (`whole`: all storm rows).

    One ordered pass over the series; the marks are few against it.
    """
    state = F.coalesce(storm, F.lit(False))
    seen = previous_row(df.withColumn("_storm", state), {"_v": index, "_s": "_storm"}, keys=keys, ts=ts, chunk=chunk)
    begins = F.col("_storm") & ~F.coalesce(F.col("_s"), F.lit(False))
    falls = F.coalesce((F.col(index) <= 0) & (F.col("_v") > 0), F.lit(False))
    rows = seen.select(
        *keys, ts, F.col(index).alias("_value"), "_storm",
        F.when(falls, F.col(ts)).alias("_fall"), F.when(begins, F.col(ts)).alias("_begin"),
    )
    wanted = F.col("_storm") if whole else F.col("_begin").isNotNull()
    return rows.filter(wanted | F.col("_fall").isNotNull())


def storm_onsets(df: DataFrame, index: str, storm: Column, *, keys: Sequence[str], ts: str, chunk: Span = "30d") -> DataFrame:
    """Per storm run the last downward zero crossing of `index` at or before the run; runs with none drop out."""
    marks = _marks(df, index, storm, keys=keys, ts=ts, chunk=chunk, whole=False)
    held = carry(marks, keys=keys, ts=ts, forward={"onset": "_fall"}, chunk=chunk)
    return held.filter(F.col("_begin").isNotNull() & F.col("onset").isNotNull()).select(*keys, "onset")


def greedy_spacing(df: DataFrame, *, keys: Sequence[str], ts: str, gap: Span = "4h", chunk: Span = "30d") -> DataFrame:
    """Keep a time when it lies at least `gap` after the last *kept* one.

    Each choice depends on the one before, but a chunk needs to know only the last kept time before
    it.  So every chunk first reports, for each time that could be its first kept one, the time it
    would keep last; the short list of chunks is then followed in order, and each chunk is cut again
    from its now known entry.  No task ever holds more than one chunk's times or one series' reports.
    """
    width, apart = span_us(chunk), span_us(gap)
    kind = df.schema[ts].dataType
    times = df.select(*keys, micros(ts).alias(US)).distinct().withColumn(CHUNK, floor_to(F.col(US), width))
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    head = f"{fields}, " if keys else ""

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf[US].to_numpy())
        following = np.searchsorted(at, at + apart)
        final = at.copy()
        for i in range(len(at) - 1, -1, -1):
            if following[i] < len(at):
                final[i] = final[following[i]]
        start = pdf[CHUNK].iloc[0]
        # a chunk is entered at one of its times below start + gap, or at the first one after
        entries = min(int(np.searchsorted(at, start + apart)) + 1, len(at))
        out = pdf[[*keys, CHUNK]].iloc[[0]].copy()
        out["_entry"], out["_exit"] = [at[:entries].tolist()], [final[:entries].tolist()]
        return out

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        last, before = None, []
        for entry, leave in zip(pdf["_entry"], pdf["_exit"]):
            before.append(last)
            i = 0 if last is None else int(np.searchsorted(np.asarray(entry), last + apart))
            if i < len(entry):
                last = int(leave[i])
        out = pdf[[*keys, CHUNK]].copy()
        out["_last"] = pd.array(before, dtype="Int64")
        return out

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(US)
        last, keep = pdf["_last"].iloc[0], []
        for t in pdf[US]:
            ok = pd.isna(last) or t - last >= apart
            keep.append(ok)
            last = t if ok else last
        return pdf.loc[keep, [*keys, US]]

    reports = times.groupBy(*keys, CHUNK).applyInPandas(report, f"{head}{CHUNK} long, _entry array<long>, _exit array<long>")
    entered = reports.groupBy(*keys).applyInPandas(follow, f"{head}{CHUNK} long, _last long")
    known = times.join(entered, [*keys, CHUNK])
    kept = known.groupBy(*keys, CHUNK).applyInPandas(choose, f"{head}{US} long")
    return kept.select(*keys, F.timestamp_micros(US).cast(kind).alias(ts))


def hazard_labels(
    index: DataFrame, onsets: DataFrame, *, keys: Sequence[str], ts: str, onset: str, horizons: int = 8
) -> DataFrame:
    """`h_1..h_n`: 1 when an onset lies in `(h-1, h]` hours after the row.

    Onsets are few; each is spread over the hours that can see it, the index is reduced to the same
    hours, and the two meet in an equi join whose residual decides the horizon.
    """
    hour = F.lit(HOUR_US).cast("long")
    spread = onsets.select(
        *keys,
        micros(onset).alias("_o"),
    ).distinct()
    last = floor_to(F.col("_o"), HOUR_US)
    spread = spread.withColumn("_hour", F.explode(F.sequence(last - F.lit(horizons * HOUR_US), last, hour)))
    near = (
        index.select(*keys, ts, micros(ts).alias(US))
        .withColumn("_hour", floor_to(F.col(US), HOUR_US))
        .join(spread, [*keys, "_hour"])
        .withColumn("_h", F.ceil((F.col("_o") - F.col(US)) / F.lit(HOUR_US)))
        .filter(F.col("_h").between(1, horizons))
    )
    names = [f"h_{h}" for h in range(1, horizons + 1)]
    marks = near.select(*keys, ts, *[(F.col("_h") == h).cast("int").alias(n) for h, n in enumerate(names, 1)])
    zeros = index.select(*keys, ts, *[F.lit(0).alias(n) for n in names])
    return zeros.unionByName(marks).groupBy(*keys, ts).agg(*[F.max(n).alias(n) for n in names])


def interval_labels(index: DataFrame, onsets: DataFrame, *, keys: Sequence[str], ts: str, onset: str, horizons: int = 8) -> DataFrame:
    """Long form of `hazard_labels`: one row (row time, h) per positive label."""
    wide = hazard_labels(index, onsets, keys=keys, ts=ts, onset=onset, horizons=horizons)
    pairs = F.array(*[F.when(F.col(f"h_{h}") == 1, F.lit(h)) for h in range(1, horizons + 1)])
    return wide.select(*keys, ts, F.explode(F.array_compact(pairs)).alias("h"))


def count_onsets(labels: DataFrame, *, keys: Sequence[str], ts: str, horizons: int = 8) -> DataFrame:
    """Distinct onset hours that the labels point at."""
    pointed = F.array_compact(
        F.array(*[F.when(F.col(f"h_{h}") == 1, micros(ts) + F.lit(h * HOUR_US)) for h in range(1, horizons + 1)])
    )
    return labels.select(*keys, F.explode(pointed).alias("_at")).groupBy(*keys).agg(F.count_distinct("_at").alias("n_onsets"))


def merge_intervals(
    df: DataFrame, *, keys: Sequence[str], start: str, end: str, touch: Span = "1h", chunk: Span = "30d"
) -> DataFrame:
    """Union of intervals that overlap or touch within `touch`."""
    rows = with_chunk(df.select(*keys, start, end).distinct(), start, chunk)
    # the furthest end over all earlier intervals: a running maximum, handed on from chunk to chunk
    reach = rows.groupBy(*keys, CHUNK).agg(F.max(end).alias("_reach"))
    context = reach.select(*keys, CHUNK, F.max("_reach").over(before(over_chunks(keys))).alias("_reach"))
    both = with_context(rows, context)
    far = F.max(F.coalesce("_reach", end)).over(before(chunk_window(keys, US, end)))
    seen = both.withColumn("_far", far).filter(~F.col(HALO))
    opens = F.col("_far").isNull() | (micros(start) > micros("_far") + F.lit(span_us(touch)))
    opened = seen.select(*keys, start, end, F.when(opens, F.col(start)).alias("_open"))
    named = carry(opened, keys=keys, ts=start, forward={"_in": "_open"}, chunk=chunk, order=[end])
    return named.groupBy(*keys, F.col("_in").alias(start)).agg(F.max(end).alias(end))


def storm_intervals(df: DataFrame, index: str, storm: Column, *, keys: Sequence[str], ts: str, chunk: Span = "30d") -> DataFrame:
    """From each run's onset (or its start) to its minimum of `index`, merged where they touch."""
    marks = _marks(df, index, storm, keys=keys, ts=ts, chunk=chunk, whole=True)
    held = carry(marks, keys=keys, ts=ts, forward={"_onset": "_fall", "_run": "_begin"}, chunk=chunk).filter("_storm")
    spans = held.groupBy(*keys, "_run").agg(
        F.min_by(F.struct("_onset"), F.col(ts)).alias("_o"), F.min_by(ts, F.struct("_value", ts)).alias("end")
    )
    spans = spans.select(*keys, F.coalesce("_o._onset", "_run").alias("start"), "end")
    return merge_intervals(spans, keys=keys, start="start", end="end", chunk=chunk)
