"""Feeds: what a landed feed looks like and how it is kept, plus scans, sinks and backfill windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormline.operators.quality import clean_doubles
from stormline.operators.upsert import evolve, upsert_ignore, upsert_replace
from stormline.sources import text

TIME_NAMES = ("time_tag", "timestamp", "date")


def _schema(time: str, doubles: Sequence[str], strings: Sequence[str] = ("source_type",)) -> T.StructType:
    return T.StructType(
        [T.StructField(time, T.TimestampType())]
        + [T.StructField(c, T.DoubleType()) for c in doubles]
        + [T.StructField(c, T.StringType()) for c in strings]
    )


@dataclass(frozen=True)
class Feed:
    """A feed: schema, key, time column, what wins on conflict, and how landed lines (or documents) are parsed."""

    name: str
    schema: T.StructType
    key: tuple[str, ...] = ("time_tag",)
    time: str = "time_tag"
    conflict: str = "replace"
    parse: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    documents: bool = False

    def shape(self, df: DataFrame) -> DataFrame:
        """Parsed rows in the feed's schema: absent columns NULL, NaN and infinities NULL, bad times dropped."""
        return clean_doubles(project_reindex(df, self.schema)).filter(F.col(self.time).isNotNull())

    def rows(self, landed: DataFrame) -> DataFrame:
        """Landed `(file, seq, line, month)`, or `(file, payload, month)` for a feed of documents, as rows of the feed."""
        return self.shape(self.parse(landed))

    def upsert(self, old: DataFrame, new: DataFrame, order: Sequence[str | Column] = ()) -> DataFrame:
        write = upsert_replace if self.conflict == "replace" else upsert_ignore
        return write(old, new, self.key, order)


def _series(*cols: str, **renamed: str) -> dict:
    """Documents that hold a series; `renamed` gives the document's name of a column, or several to choose from."""
    names = [*cols, *renamed]

    def parse(docs: DataFrame) -> DataFrame:
        rows = text.parse_json_series(docs, "payload", ("time_tag", "time", "datetime"), names)
        targets = dict.fromkeys([*cols, *renamed.values()])
        return rows.select("time_tag", *[F.coalesce(*[F.col(n) for n in names if renamed.get(n, n) == c]).alias(c) for c in targets])

    return {"parse": parse, "documents": True}


def _hourly(lines: DataFrame) -> DataFrame:
    """Plain lines, and the `<pre>` blocks of pages."""
    page = F.col("file").rlike(r"\.html?$")
    plain = text.parse_hourly_matrix(lines.filter(~page), F.col("month"), keep=("file", "seq", "month"))
    return plain.unionByName(text.parse_pre_block(lines.filter(page), F.col("month"), keep=("file", "seq", "month")))


def _catalogue(lines: DataFrame) -> DataFrame:
    cells = text.parse_pipe_catalogue(lines).join(lines.select("file", "seq", "month"), ["file", "seq"])
    months = cells.select("file", "seq", "month")
    return text.catalogue_rows(cells.drop("month"), F.lit(None)).drop("catalog_month").join(months, ["file", "seq"]).withColumnRenamed("month", "catalog_month")


# Schemas, keys and conflict rules of the feeds.
_FLARE = ("peak_flux_wm2", "xrsb_flux", "background_flux", "integrated_flux")

FEEDS: dict[str, Feed] = {
    f.name: f
    for f in (
        Feed("dst", _schema("time_tag", ["dst"]), parse=_hourly),
        Feed("kp_index", _schema("time_tag", ["kp_index"]), **_series(kp="kp_index")),
        Feed("sunspot_number", _schema("time_tag", ["sunspot_number"]), **_series("sunspot_number", ssn="sunspot_number")),
        Feed("radio_flux", _schema("time_tag", ["observed_flux", "adjusted_flux", "ursi_flux"]), parse=lambda lines: text.parse_flux_table(lines)),
        Feed("imf_a", _schema("time_tag", ["bx_gsm", "by_gsm", "bz_gsm", "bt"]), **_series("bx_gsm", "by_gsm", "bz_gsm", "bt")),
        Feed("imf_b", _schema("time_tag", ["bt", "bx", "by", "bz"]), conflict="ignore", **_series("bt", bx_gsm="bx", by_gsm="by", bz_gsm="bz")),
        Feed("plasma_a", _schema("time_tag", ["density", "speed", "temperature"]), conflict="ignore", **_series("density", "speed", "temperature")),
        Feed("plasma_b", _schema("time_tag", ["density", "speed", "temperature"]), conflict="ignore", **_series("density", "speed", "temperature")),
        Feed(
            "xray_flux",
            _schema("time_tag", ["irradiance_xrsa1", "irradiance_xrsa2", "irradiance_xrsb1", "irradiance_xrsb2", "xrs_ratio"]),
            **_series("irradiance_xrsa1", "irradiance_xrsa2", "irradiance_xrsb1", "irradiance_xrsb2", "xrs_ratio"),
        ),
        Feed(
            "cme",
            _schema(
                "time_tag",
                ["dt_minutes", "position_angle", "angular_width", "median_velocity", "velocity_variation", "min_velocity", "max_velocity"],
                ["event_id", "cme_number", "halo_class", "source_type"],
            ).add("catalog_month", T.DateType()),
            key=("event_id",),
            parse=_catalogue,
        ),
        Feed(
            "flares_realtime",
            _schema("event_time", _FLARE, ["flare_id", "flare_class", "status", "source_day", "satellite"]),
            key=("flare_id",),
            time="event_time",
            parse=text.parse_flare_lines,
        ),
        Feed(
            "flares_archive",
            _schema("event_time", _FLARE, ["flare_id", "flare_class", "status", "satellite", "source_day", "file_url"]),
            key=("flare_id", "event_time"),
            time="event_time",
            parse=text.parse_flare_lines,
        ),
    )
}


def read_feed(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Rows of a folder of landed files, read by Spark itself; `landed.py` has the same as a data source.

    The month of a file is the first year and month in its path below the folder.
    """
    feed = FEEDS[name]
    if feed.documents:
        files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))
    else:
        files = text.read_lines(spark, path)
    below = F.regexp_replace("file", F.lit(".*" + re.escape(path.rstrip("/").split("://")[-1])), F.lit(""))
    parts = [F.regexp_extract(below, r"(?<!\d)([1-9]\d{3})[-_]?(0[1-9]|1[0-2])", i) for i in (1, 2)]
    return feed.rows(files.withColumn("month", F.when(parts[0] != "", F.concat(parts[0], F.lit("-"), parts[1], F.lit("-01"))).cast("date")))


def project_reindex(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, cast; columns the frame lacks are NULL."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def project_listed(df: DataFrame, listed: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Keys and those of the listed features that exist, in list order."""
    return df.select(*keys, *[c for c in listed if c in df.columns and c not in keys])


def scan_timeseries(df: DataFrame, time: str, cols: Sequence[str]) -> DataFrame:
    """Project, read the time as an instant, drop rows without one.  No global sort: order is a window's business."""
    kind = df.schema[time].dataType.typeName()
    instant = F.try_to_timestamp(F.col(time)) if kind == "string" else F.col(time).cast("timestamp")
    return df.select(instant.alias(time), *cols).filter(F.col(time).isNotNull())


def detect_time(df: DataFrame, names: Sequence[str] = TIME_NAMES, out: str = "ts") -> DataFrame:
    """Rename the first time column present; a frame without one is an error."""
    for name in names:
        if name in df.columns:
            return df.withColumnRenamed(name, out)
    raise ValueError(f"no time column among {', '.join(names)}")


def read_stage(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stage table, or an empty frame of its schema when it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ("split",)) -> None:
    """Replace a stage table; with dynamic overwrite only the partitions present in `df` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(path)


def write_tail(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that `df` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def time_between(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Inclusive range.  Bounds are cast to the column's own type, so the comparison reaches the file scan."""
    kind = df.schema[ts].dataType
    return df.filter((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) <= F.lit(end).cast(kind)))


def days_between(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Whole days, both inclusive, as a half-open range on the bare column."""
    kind = df.schema[ts].dataType
    after = F.date_add(F.lit(last).cast("date"), 1).cast(kind)
    return df.filter((F.col(ts) >= F.lit(first).cast("date").cast(kind)) & (F.col(ts) < after))


def segments(start: str, end: str, realtime_from: str, archive: tuple[str | None, str | None] = (None, None)) -> list[tuple[str, str, str]]:
    """(dataset, first day, last day) of a range of days: the archive within its own bounds and before the switch, the
    realtime feed from the switch on; a range that neither covers is asked of the realtime feed as it is."""
    before = (date.fromisoformat(realtime_from) - timedelta(days=1)).isoformat()
    first, last = max(start, archive[0] or start), min(end, archive[1] or end, before)
    found = [("archive", first, last)] if first <= last else []
    if end >= realtime_from:
        found.append(("realtime", max(start, realtime_from), end))
    return found or [("realtime", start, end)]


def route_segments(
    archive: DataFrame, realtime: DataFrame, ts: str, *, start: str, end: str, realtime_from: str, archive_days: tuple[str | None, str | None] = (None, None)
) -> DataFrame:
    """Rows of each segment from its own feed, with a `dataset` tag; days are inclusive and read as ISO dates."""
    feeds = {"archive": archive, "realtime": realtime}
    parts = [days_between(feeds[name], ts, a, b).withColumn("dataset", F.lit(name)) for name, a, b in segments(start, end, realtime_from, archive_days)]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def dispatch(routed: DataFrame, stored: dict[str, DataFrame], kinds: dict[str, Feed], order: Sequence[str | Column] = ()) -> dict[str, DataFrame]:
    """Routed rows go to the table of their dataset: per dataset the stored rows after the feed's own upsert."""
    out = {}
    for name, old in stored.items():
        mine = routed.filter(F.col("dataset") == name).drop("dataset")
        out[name] = kinds[name].upsert(old, kinds[name].shape(mine), order)
    return out


def effective(days: DataFrame, day: str, windows: Sequence[tuple[str, int, str, str | None]], *, first_match: bool = False) -> DataFrame:
    """The satellite in charge of each day, from (name, number, start, end or None) windows.

    Newest number among those open that day, or the first in list order.  The list is a literal of a
    few entries, so it is a column expression and no join is needed; days without one drop out.
    """
    options = []
    for place, (name, number, start, end) in enumerate(windows):
        open_ = F.col(day) >= F.lit(start).cast("date")
        if end is not None:
            open_ = open_ & (F.col(day) <= F.lit(end).cast("date"))
        rank = -place if first_match else number
        options.append(F.when(open_, F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return days.withColumn("satellite", best["name"]).filter(F.col("satellite").isNotNull())



def pending_windows(marks: DataFrame, source: str, mark: str, end: str, days: int) -> DataFrame:
    """Per source the inclusive windows of `days` days after its high-water mark up to `end`; finished sources have none."""
    last = F.lit(end).cast("date")
    begun = marks.select(source, F.date_add(F.col(mark).cast("date"), 1).alias("_next")).filter(F.col("_next") <= last)
    starts = begun.select(source, F.explode(F.sequence(F.col("_next"), last, F.make_dt_interval(F.lit(days)))).alias("start"))
    return starts.select(source, "start", F.least(F.date_add("start", days - 1), last).alias("end"))


def snapshot_latest(tables: dict[str, tuple[DataFrame, str]], hours: int) -> DataFrame:
    """Rows of each table within `hours` of the newest time over all tables; one frame with a `source` tag."""
    tops = None
    for df, ts in tables.values():
        top = df.agg(F.max(F.col(ts).cast("timestamp")).alias("t"))
        tops = top if tops is None else tops.unionByName(top)
    cutoff = tops.agg((F.max("t") - F.make_dt_interval(F.lit(0), F.lit(hours))).alias("c")).scalar()
    out = None
    for name, (df, ts) in tables.items():
        kept = df.filter(F.col(ts) >= cutoff.cast(df.schema[ts].dataType)).withColumn("source", F.lit(name))
        out = kept if out is None else out.unionByName(kept, allowMissingColumns=True)
    return out


def time_like(df: DataFrame) -> list[str]:
    """Columns whose name holds `time` or `date`, in any letter case."""
    return [c for c in df.columns if "time" in c.lower() or "date" in c.lower()]


def high_water_mark(df: DataFrame, source: str, times: Sequence[str] | None = None) -> DataFrame:
    """Newest time per source over its time columns: the named ones that exist and hold a time, else all that are
    named like one. Texts are read as times, those that are none count as missing; a source without any has NULL."""

    def newest(names: Sequence[str]) -> Column:
        kinds = dict(df.dtypes)
        tops = [F.max(F.try_to_timestamp(c) if kinds[c] == "string" else F.col(c).cast("timestamp")) for c in names if c != source and kinds[c] in ("string", "date", "timestamp", "timestamp_ntz")]
        return F.greatest(*tops) if len(tops) > 1 else tops[0] if tops else F.lit(None).cast("timestamp")

    named = [c for c in times or () if c in df.columns]
    best = F.coalesce(newest(named), newest(time_like(df))) if named else newest(time_like(df))
    return df.groupBy(source).agg(best.alias("latest_timestamp"))


def advance_marks(old: DataFrame, seen: DataFrame, source: str) -> DataFrame:
    """Marks never move back."""
    return old.unionByName(seen).groupBy(source).agg(F.max("latest_timestamp").alias("latest_timestamp"))


def source_breakdown(df: DataFrame, ts: str, col: str = "source_type", default: str = "archive") -> DataFrame:
    named = F.coalesce(F.col(col), F.lit(default)).alias(col)
    return df.groupBy(named).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """A small result as one CSV or JSON file."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", "true").csv(path) if form == "csv" else writer.json(path)


__all__ = [
    "FEEDS", "Feed", "advance_marks", "days_between", "detect_time", "dispatch", "effective", "evolve", "high_water_mark", "pending_windows",
    "project_listed", "project_reindex", "read_feed", "read_stage", "route_segments", "scan_timeseries", "segments", "snapshot_latest",
    "source_breakdown", "time_between", "time_like", "write_report", "write_stage", "write_tail",
]
