"""Projections, filters, splits, sets, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormline.operators import quality as Q
from stormline.operators import sets
from stormline.operators.joins import prefix_columns
from stormline.operators.segments import drop_long_missing
from stormline.sources import feeds

from .fixtures import events, feed, gridded, hourly, r6, rounded, table, wide
from .registry import query
from .registry import r6 as s6
from .registry import sql

WINDOWS = {
    "train": ("2024-01-01 00:00:00", "2024-01-20 23:59:59"),
    "validation": ("2024-01-21 00:00:00", "2024-01-25 23:59:59"),
    "test": ("2024-01-26 00:00:00", "2024-01-30 00:00:00"),
}


@query("project_reindex", sql(f"SELECT ts, {s6('bx')} AS bx, {s6('bt')} AS bt, CAST(NULL AS DOUBLE) AS temperature FROM WIDE", "WIDE"))
def project_reindex(spark, sf_dir):
    schema = T.StructType([T.StructField("ts", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in ("bx", "bt", "temperature")]])
    return rounded(feeds.project_reindex(wide(spark, sf_dir), schema), "bx", "bt")


@query("prefix_columns", sql(f"SELECT ts, {s6('bx')} AS imf_bx, {s6(chr(34) + 'by' + chr(34))} AS imf_by, {s6('bz')} AS imf_bz FROM WIDE", "WIDE"))
def prefix(spark, sf_dir):
    return prefix_columns(rounded(wide(spark, sf_dir).select("ts", "bx", "by", "bz"), "bx", "by", "bz"), "imf", ["ts"])


@query("project_feature_list", sql(f"SELECT ts, {s6('speed')} AS speed, {s6('bz')} AS bz FROM WIDE", "WIDE"))
def project_feature_list(spark, sf_dir):
    return feeds.project_listed(rounded(wide(spark, sf_dir), "speed", "bz"), ["speed", "absent", "bz", "ts"], ["ts"])


@query("numeric_complete", sql(f"SELECT i, {s6('v')} AS v FROM G WHERE v IS NOT NULL", "G"))
def numeric_complete(spark, sf_dir):
    return rounded(Q.numeric_complete(gridded(spark, sf_dir)), "v")


@query("numeric_zero_fill", sql(f"SELECT i, {s6('coalesce(v, 0)')} AS v FROM G", "G"))
def numeric_zero_fill(spark, sf_dir):
    return rounded(Q.numeric_zero_fill(gridded(spark, sf_dir)), "v")


@query("filter_date_range", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1999-02-28'")
def filter_date_range(spark, sf_dir):
    df = feeds.days_between(table(spark, sf_dir, "orders"), "o_orderdate", "1996-03-01", "1999-02-28")
    return df.select("o_orderkey", "o_orderdate", "o_totalprice")


@query("filter_required", sql(f"SELECT k, ts, {s6('v')} AS v FROM G WHERE v IS NOT NULL", "G"))
def filter_required(spark, sf_dir):
    return rounded(gridded(spark, sf_dir).dropna(subset=["v"]).drop("i"), "v")


@query("sentinel_to_null", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS v, CASE WHEN value BETWEEN 10 AND 60 THEN value END AS guarded FROM events")
def sentinel_to_null(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("raw", F.when(F.col("event_id") % 9 == 0, -9999.0).otherwise(F.col("value")))
    return df.select("event_id", Q.sentinel_to_null(F.col("raw"), -9999.0, 1e-6).alias("v"), Q.within_or_null(F.col("value"), 10, 60).alias("guarded"))


@query("floor_clip", sql(f"SELECT k, ts, CASE WHEN v IS NULL THEN NULL WHEN v - 50 <= 1e-9 THEN 0.0 ELSE {s6('v - 50')} END AS v FROM G", "G"))
def floor_clip(spark, sf_dir):
    return gridded(spark, sf_dir).select("k", "ts", Q.floor_clip(r6(F.col("v") - 50), 1e-9).alias("v"))


@query("inf_to_null", "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN NULL ELSE value END AS v FROM events")
def inf_to_null(spark, sf_dir):
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, float("inf")).when(i % 5 == 1, float("-inf")).when(i % 5 == 2, float("nan")).otherwise(F.col("value"))
    return events(spark, sf_dir).select("event_id", Q.finite(raw).alias("v"))


@query("missing_flag_all", sql("SELECT ts, CAST(a.v IS NULL AND b.v IS NULL AS INTEGER) AS missing_flag FROM FEED_A a JOIN FEED_B b USING (ts)", "FEED_A", "FEED_B"))
def missing_flag_all(spark, sf_dir):
    a, b = feed(spark, sf_dir, "click"), feed(spark, sf_dir, "view").withColumnRenamed("v", "w")
    return a.join(b, "ts").select("ts", Q.all_missing_flag(["v", "w"]).alias("missing_flag"))


_CASE = " ".join(f"WHEN ts >= TIMESTAMP '{a}' AND ts <= TIMESTAMP '{b}' THEN '{s}'" for s, (a, b) in WINDOWS.items())
_SPLIT = f"SELECT * FROM (SELECT k, ts, v, CASE {_CASE} END AS split FROM H) WHERE split IS NOT NULL"


@query("temporal_split", sql(f"SELECT k, ts, {s6('v')} AS v, split FROM S", "H", S=_SPLIT))
def temporal_split(spark, sf_dir):
    return rounded(Q.temporal_split(hourly(spark, sf_dir).drop("n"), "ts", WINDOWS), "v")


@query("temporal_split_skip", sql(f"SELECT k, ts, {s6('v')} AS v, unnest(['train', 'validation', 'test']) AS split FROM H", "H"))
def temporal_split_skip(spark, sf_dir):
    return rounded(Q.temporal_split(hourly(spark, sf_dir).drop("n"), "ts", WINDOWS, skip=True), "v")


@query("split_day_normalized", sql("SELECT event_id, ts, split FROM (SELECT event_id, date_trunc('day', ts) AS ts, CASE "
       + _CASE.replace("ts >=", "date_trunc('day', ts) >=").replace("ts <=", "date_trunc('day', ts) <=") + " END AS split FROM events) WHERE split IS NOT NULL"))
def split_day_normalized(spark, sf_dir):
    return Q.temporal_split(events(spark, sf_dir).select("event_id", "ts"), "ts", WINDOWS, day_labels=True)


@query("split_counts", sql("SELECT split, count(*) AS n FROM S GROUP BY split", "H", S=_SPLIT))
def split_counts(spark, sf_dir):
    return Q.split_counts(Q.temporal_split(hourly(spark, sf_dir), "ts", WINDOWS), WINDOWS)


@query("point_lookup", sql(f"SELECT k, ts, {s6('v')} AS v, split FROM S WHERE ts = TIMESTAMP '2024-01-22 10:00:00' AND split = 'validation'", "H", S=_SPLIT))
def point_lookup(spark, sf_dir):
    df = Q.temporal_split(hourly(spark, sf_dir).drop("n"), "ts", WINDOWS)
    return rounded(df.filter((F.col("ts") == F.lit("2024-01-22 10:00:00").cast("timestamp")) & (F.col("split") == "validation")), "v")


@query("union_splits", sql(f"SELECT k, ts, {s6('v')} AS v, CAST(NULL AS BIGINT) AS n, 'train' AS split FROM H UNION ALL SELECT k, ts, {s6('v')}, n, 'test' FROM H", "H"))
def union_splits(spark, sf_dir):
    h = rounded(hourly(spark, sf_dir), "v")
    return sets.union_all([h.drop("n").withColumn("split", F.lit("train")), h.withColumn("split", F.lit("test"))])


_TIMES = {"a": "SELECT ts FROM FEED_A WHERE v IS NOT NULL", "b": "SELECT ts FROM FEED_B WHERE v > 50"}


def _times(spark, sf_dir):
    return feed(spark, sf_dir, "click").filter("v IS NOT NULL"), feed(spark, sf_dir, "view").filter("v > 50")


@query("union_times", sql(f"{_TIMES['a']} UNION {_TIMES['b']}", "FEED_A", "FEED_B"))
def union_times(spark, sf_dir):
    return sets.union_times(*_times(spark, sf_dir), ["ts"])


@query("intersect_times", sql(f"{_TIMES['a']} INTERSECT {_TIMES['b']}", "FEED_A", "FEED_B"))
def intersect_times(spark, sf_dir):
    return sets.intersect_times(*_times(spark, sf_dir), ["ts"])


@query("except_times", sql(f"{_TIMES['a']} EXCEPT {_TIMES['b']}", "FEED_A", "FEED_B"))
def except_times(spark, sf_dir):
    return sets.except_times(*_times(spark, sf_dir), ["ts"])


@query("latest_n", sql(f"SELECT k, ts, {s6('v')} AS v FROM H ORDER BY ts DESC, k DESC LIMIT 720", "H"))
def latest_n(spark, sf_dir):
    return rounded(sets.latest_n(hourly(spark, sf_dir).drop("n"), 720, ["ts", "k"]), "v")


@query("latest_row", "SELECT event_type AS k, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS v FROM events GROUP BY 1")
def latest_row(spark, sf_dir):
    df = events(spark, sf_dir).select(F.col("event_type").alias("k"), "ts", "event_id", F.col("value").alias("v"))
    return sets.latest_row(df, keys=["k"], order=["ts"])


_ALL_GONE = "SELECT a.ts, a.v AS a, b.v AS b FROM FEED_A a JOIN FEED_B b USING (ts) WHERE a.ts >= TIMESTAMP '2024-01-02'"


@query("drop_long_gaps", sql(
    f"""SELECT ts, {s6('a')} AS a, {s6('b')} AS b FROM (SELECT *, count(*) OVER (PARTITION BY gone, grp) AS len FROM (SELECT *,
        row_number() OVER (ORDER BY ts) - row_number() OVER (PARTITION BY gone ORDER BY ts) AS grp FROM (SELECT *, a IS NULL AND b IS NULL AS gone FROM P)))
        WHERE NOT (gone AND len > 12)""", "FEED_A", "FEED_B", P=_ALL_GONE))
def drop_long_gaps(spark, sf_dir):
    a, b = feed(spark, sf_dir, "click").withColumnRenamed("v", "a"), feed(spark, sf_dir, "view").withColumnRenamed("v", "b")
    both = a.join(b, "ts").filter(F.col("ts") >= F.lit("2024-01-02").cast("timestamp"))
    return rounded(drop_long_missing(both, ["a", "b"], 12, keys=[], ts="ts", chunk="5d"), "a", "b")
