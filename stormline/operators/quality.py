"""Missing values, sentinels, row-wise repairs and temporal splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import POS, Span, micros, positions, span_us
from .fill import carry


def clean_doubles(df: DataFrame) -> DataFrame:
    """NaN and infinities are missing, so they become NULL (Spark would rank NaN above all values)."""
    return df.select(
        *[
            finite(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def sentinel_to_null(value: Column, sentinel: float, tolerance: float = 0.0) -> Column:
    return F.when(F.abs(value - F.lit(sentinel)) > tolerance, value)


def within_or_null(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def floor_clip(value: Column, floor: float = 1e-9) -> Column:
    """Background at or below the floor and negatives become 0; missing stays missing."""
    return F.when(value.isNull(), None).when(value <= floor, 0.0).otherwise(value)


def clip_low(value: Column, low: float) -> Column:
    return F.when(value < low, low).otherwise(value)


def clip_high(value: Column, high: float) -> Column:
    return F.when(value > high, high).otherwise(value)


def all_missing_flag(cols: Sequence[str]) -> Column:
    return F.coalesce(*cols).isNull().cast("int")


def row_median(cols: Sequence[str]) -> Column:
    """Median of the channels that have a value."""
    seen = F.array_sort(F.array_compact(F.array(*cols)))
    n = F.size(seen)
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    return F.when(n > 0, (F.get(seen, low.cast("int")) + F.get(seen, high.cast("int"))) / 2)


def safe_ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]


def numeric_complete(df: DataFrame) -> DataFrame:
    cols = numeric_columns(df)
    return df.select(*cols).dropna("any")


def numeric_zero_fill(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit(0)).cast(df.schema[c].dataType).alias(c) for c in numeric_columns(df)])


def missing_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in cols])


def require_complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail the job, when it runs, on the first missing value in the named columns."""
    guard = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])
    checked = {c: F.when(guard.isNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("missing value in "), guard))) for c in cols[:1]}
    return df.withColumns(checked)


Windows = dict[str, tuple[str, str]]


def temporal_split(df: DataFrame, ts: str, windows: Windows, *, skip: bool = False, day_labels: bool = False) -> DataFrame:
    """Add `split` by inclusive time windows and drop rows outside all of them.

    With `skip` every row goes into every split; `day_labels` floors the time to its day first.
    """
    kind = df.schema[ts].dataType
    if day_labels:
        df = df.withColumn(ts, F.date_trunc("day", ts).cast(kind))
    if skip:
        return df.withColumn("split", F.explode(F.array(*[F.lit(s) for s in windows])))
    chosen = F.lit(None).cast("string")
    inside = F.lit(False)
    for name, (start, end) in reversed(windows.items()):
        here = (F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) <= F.lit(end).cast(kind))
        chosen = F.when(here, name).otherwise(chosen)
        inside = here | inside
    return df.filter(inside).withColumn("split", chosen)


def split_counts(df: DataFrame, windows: Windows) -> DataFrame:
    """Rows per split, with 0 for an empty one."""
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in windows])).alias("split"))
    counted = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    both = counted.unionByName(names.withColumn("n", F.lit(0).cast("long")))
    return both.groupBy("split").agg(F.sum("n").alias("n"))


def split_bounds(df: DataFrame, ts: str, names: Sequence[str] = ("train", "validation", "test")) -> Windows:
    """Windows from the rows of already split data: from the floor hour of a split's first time to the ceiling hour of its
    last. A split without a time is an error."""
    hour = F.lit(3_600_000_000)
    lo, hi = F.min(micros(ts)), F.max(micros(ts))
    found = {
        r["split"]: (r["a"], r["b"])
        for r in df.filter(F.col("split").isin(*names) & F.col(ts).isNotNull()).groupBy("split").agg(
            F.date_format(F.timestamp_micros((F.floor(lo / hour) * hour).cast("long")), "yyyy-MM-dd HH:mm:ss").alias("a"),
            F.date_format(F.timestamp_micros((F.ceil(hi / hour) * hour).cast("long")), "yyyy-MM-dd HH:mm:ss").alias("b"),
        ).collect()
    }
    if missing := [n for n in names if n not in found]:
        raise ValueError(f"empty split: {', '.join(missing)}")
    return {n: found[n] for n in names}


def require_splits(df: DataFrame, windows: Windows) -> None:
    """Raise when a split has no rows."""
    empty = [r["split"] for r in split_counts(df, windows).filter("n = 0").collect()]
    if empty:
        raise ValueError(f"empty split: {', '.join(sorted(empty))}")


def impute_gap_rule(
    df: DataFrame,
    cols: Sequence[str],
    *,
    keys: Sequence[str],
    ts: str,
    small: int = 3,
    step: Span | None = None,
    chunk: Span = "30d",
) -> DataFrame:
    """Gaps of at most `small` rows are interpolated in time; longer ones become 0.0 with a flag of 1.

    A short gap at either end of the series holds the nearest value.  Each column is judged on its own.
    """
    rows = df.withColumn(POS, F.floor(micros(ts) / F.lit(span_us(step))).cast("long")) if step else positions(df, keys=keys, ts=ts, chunk=chunk)
    us = micros(ts)
    parts = {"v": lambda c: F.col(c), "u": lambda c: us, "p": lambda c: F.col(POS)}
    rows = rows.withColumns({f"_{n}_{c}": F.when(F.col(c).isNotNull(), part(c)) for c in cols for n, part in parts.items()})
    rows = carry(
        rows,
        keys=keys,
        ts=ts,
        forward={f"_p{n}_{c}": f"_{n}_{c}" for c in cols for n in parts},
        backward={f"_n{n}_{c}": f"_{n}_{c}" for c in cols for n in parts},
        series={"_lo": (POS, "min"), "_hi": (POS, "max")},
        chunk=chunk,
    )
    repaired, flags = {}, {}
    for c in cols:
        pv, pu, pp, nv, nu, np_ = (F.col(f"_{side}{n}_{c}") for side in "pn" for n in parts)
        run = F.coalesce(np_, F.col("_hi") + 1) - F.coalesce(pp, F.col("_lo") - 1) - 1
        line = pv + (nv - pv) / (nu - pu) * (us - pu)
        near = F.coalesce(line, pv, nv)  # the line is NULL when either side is
        filled = F.when(run <= small, near)
        repaired[c] = F.coalesce(F.col(c), filled, F.lit(0.0)).alias(c)
        flags[c] = (F.col(c).isNull() & filled.isNull()).cast("int").alias(f"{c}_missing_flag")
    return rows.select(*[repaired.get(c, F.col(c)) for c in df.columns], *flags.values())
