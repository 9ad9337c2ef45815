"""Times from text and numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1, "ns": 0.001}


def epoch_to_ts(value: Column, unit: str) -> Column:
    """Epoch number to instant; NULL when it leaves the range that nanosecond clocks cover."""
    us = value * F.lit(float(UNITS[unit]))
    limit = 9_223_372_036_854_775.0
    return F.when(F.abs(us) <= limit, F.timestamp_micros(us.cast("long")))


def coerce_epoch(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Text columns to instants (column -> new name), each with one reading for the whole column.

    Date text if any value reads as a date, else the first epoch unit (s, ms, us, ns) that fits any
    value.  The choices for all columns are one aggregate, used as a scalar subquery.
    """
    tries = {}
    for col in columns:
        text = F.trim(F.col(col).cast("string"))
        number = text.try_cast("double")
        direct = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
        tries[col] = [direct, *[epoch_to_ts(number, unit) for unit in UNITS]]
    first = {
        col: F.coalesce(*[F.when(F.max(t.isNotNull()), F.lit(i)) for i, t in enumerate(options)]).alias(col)
        for col, options in tries.items()
    }
    use = df.agg(F.struct(*first.values()).alias("use")).scalar()
    out = {}
    for col, name in columns.items():
        value = F.lit(None).cast("timestamp")
        for i in reversed(range(len(tries[col]))):
            value = F.when(use[col] == i, tries[col][i]).otherwise(value)
        out[name] = value
    return df.withColumns(out)


def expand_year(two_digits: Column) -> Column:
    """70..99 are 19xx, 00..69 are 20xx."""
    return F.when(two_digits >= 70, two_digits + 1900).otherwise(two_digits + 2000)


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), text.try_cast("date"))


def filename_date(name: Column, short_prefixes: Sequence[str] = ()) -> Column:
    """Date in a file name: `dYYYYMMDD`, `YYYY-MM-DD` (also `_`, `/`), 8 digits alone, or prefix + YYMMDD."""

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(name, pattern, group).try_cast("int")

    def split8(pattern: str) -> Column:
        eight = F.regexp_extract(name, pattern, 1)
        return _date(*[F.substr(eight, F.lit(a), F.lit(n)).try_cast("int") for a, n in ((1, 4), (5, 2), (7, 2))])

    dashed = r"(\d{4})[-_/](\d{2})[-_/](\d{2})"
    options = [
        split8(r"d(\d{8})"),
        _date(part(dashed, 1), part(dashed, 2), part(dashed, 3)),
        split8(r"(?<!\d)(\d{8})(?!\d)"),
    ]
    lowered = F.lower(name)
    for prefix in short_prefixes:
        six = rf"{prefix}(\d{{2}})(\d{{2}})(\d{{2}})"
        y, m, d = [F.regexp_extract(lowered, six, g).try_cast("int") for g in (1, 2, 3)]
        options.append(_date(expand_year(y), m, d))
    return F.coalesce(*options)


def event_id(ts: Column, number: Column) -> Column:
    """`YYYYmmddHHMM-NNNN`, or the padded number alone when there is no time."""
    padded = F.when(F.length(F.coalesce(number, F.lit(""))) >= 4, number).otherwise(F.lpad(F.coalesce(number, F.lit("")), 4, "0"))
    return F.coalesce(F.concat(F.date_format(ts, "yyyyMMddHHmm"), F.lit("-"), padded), padded)
