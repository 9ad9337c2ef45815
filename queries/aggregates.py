"""Resampling, buckets, dedupes, marks and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormline.operators import quality as Q
from stormline.operators import resample as A
from stormline.operators import upsert as U
from stormline.operators.events import count_onsets, hazard_labels
from stormline.sources import feeds

from .fixtures import feed, gridded, hourly, keyed, r6, rounded, table, wide
from .registry import query
from .registry import r6 as s6
from .registry import sql

KEYED = {"keys": ["k"], "ts": "ts"}
_GRID = "SELECT k, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM HB"


@query("resample_mean", sql(f"SELECT g.k, g.ts, {s6('H.v')} AS v FROM GR g LEFT JOIN H ON H.k = g.k AND H.ts = g.ts", "HB", GR=_GRID))
def resample_mean(spark, sf_dir):
    return rounded(A.resample_mean(keyed(spark, sf_dir), ["v"], **KEYED), "v")


@query("resample_ffill", sql("SELECT g.k, g.ts, e.v FROM GR g ASOF LEFT JOIN (SELECT event_type AS k, ts, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events) e ON e.k = g.k AND e.ts <= g.ts", "HB", GR=_GRID))
def resample_ffill(spark, sf_dir):
    df = keyed(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 4 != 0, F.col("v")))
    return A.resample_last(df, ["v"], **KEYED, chunk="5d")


@query("hourly_grid", sql(
    "SELECT k, unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)) + CASE WHEN date_trunc('hour', max(ts)) = max(ts) THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END, INTERVAL 1 HOUR)) AS ts "
    "FROM (SELECT event_type AS k, ts FROM events) GROUP BY k"))
def hourly_grid(spark, sf_dir):
    return A.hourly_grid(keyed(spark, sf_dir), **KEYED)


@query("resample_daily", f"SELECT event_type AS k, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, {s6('avg(value)')} AS v FROM events GROUP BY 1, 2")
def resample_daily(spark, sf_dir):
    return rounded(A.resample(keyed(spark, sf_dir), {"v": F.avg("v")}, **KEYED, step="1d", empty=False), "v")


@query("minute_bucket", f"SELECT event_type AS k, date_trunc('minute', ts) AS minute, {s6('avg(value)')} AS v, arg_max(CASE WHEN event_id % 3 <> 0 THEN event_id END, (ts, event_id)) FILTER (event_id % 3 <> 0) AS flag FROM events GROUP BY 1, 2")
def minute_bucket(spark, sf_dir):
    df = keyed(spark, sf_dir).withColumn("flag", F.when(F.col("event_id") % 3 != 0, F.col("event_id")))
    return rounded(A.minute_bucket(df, ["v"], ["flag"], **KEYED, order=["event_id"]), "v")


@query("resample_sum_zero", sql(f"SELECT g.k, g.ts, {s6('coalesce(s, 0)')} AS v FROM GR g LEFT JOIN (SELECT event_type AS k, date_trunc('hour', ts) AS ts, sum(value) AS s FROM events GROUP BY 1, 2) e ON e.k = g.k AND e.ts = g.ts", "HB", GR=_GRID))
def resample_sum_zero(spark, sf_dir):
    return rounded(A.resample_sum_zero(keyed(spark, sf_dir), ["v"], **KEYED), "v")


_BANDS = ["click", "error", "purchase", "signup", "view"]


@query("pivot_median", "SELECT date_trunc('hour', ts) AS ts, " + ", ".join(f"{s6(f'median(value) FILTER (event_type = {b!r})')} AS {b}" for b in _BANDS) + " FROM events GROUP BY 1")
def pivot_median(spark, sf_dir):
    hour = keyed(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    return rounded(A.pivot_median(hour, keys=["ts"], band="k", value="v", bands=_BANDS), *_BANDS)


@query("row_median", sql(f"SELECT ts, {s6('CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE (a.v + b.v) / 2 END')} AS m2, {s6('list_median(list_filter([a.v, b.v, w.error], lambda x: x IS NOT NULL))')} AS m3 FROM FEED_A a JOIN FEED_B b USING (ts) JOIN WIDE w USING (ts)", "FEED_A", "FEED_B", "WIDE"))
def row_median(spark, sf_dir):
    a, b = feed(spark, sf_dir, "click").withColumnRenamed("v", "a"), feed(spark, sf_dir, "view").withColumnRenamed("v", "b")
    df = a.join(b, "ts").join(wide(spark, sf_dir).select("ts", "error"), "ts")
    return df.select("ts", r6(Q.row_median(["a", "b"])).alias("m2"), r6(Q.row_median(["a", "b", "error"])).alias("m3"))


@query("safe_ratio", f"SELECT event_id, {s6('CASE WHEN event_id % 360 * 37 % 360 <> 0 THEN value / (event_id % 360 * 37 % 360) END')} AS ratio FROM events")
def safe_ratio(spark, sf_dir):
    bottom = ((F.col("event_id") % 360 * 37) % 360).cast("double")
    return keyed(spark, sf_dir).select("event_id", r6(Q.safe_ratio(F.col("v"), bottom)).alias("ratio"))


@query("select_channel", sql(f"SELECT a.ts, {s6('CASE WHEN date_part(' + chr(39) + 'hour' + chr(39) + ', a.ts) % 2 = 0 THEN a.v ELSE b.v END')} AS v FROM FEED_A a JOIN FEED_B b USING (ts)", "FEED_A", "FEED_B"))
def select_channel(spark, sf_dir):
    a, b = feed(spark, sf_dir, "click"), feed(spark, sf_dir, "view").withColumnRenamed("v", "w")
    flag = F.hour("ts") % 2
    return a.join(b, "ts").select("ts", r6(F.when(flag == 0, F.col("v")).otherwise(F.col("w"))).alias("v"))


def _ranked(order: str) -> str:
    return f"SELECT user_id, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rn FROM events) WHERE rn = 1"


def _users(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")


@query("dedupe_first", _ranked("ts, event_id"))
def dedupe_first(spark, sf_dir):
    return U.dedupe_first(_users(spark, sf_dir), ["user_id"], ["ts", "event_id"])


@query("dedupe_last", _ranked("ts DESC, event_id DESC"))
def dedupe_last(spark, sf_dir):
    return U.dedupe_last(_users(spark, sf_dir), ["user_id"], ["ts", "event_id"])


@query("dedupe_valid", "SELECT user_id, ts, event_id, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v IS NOT NULL DESC, ts DESC, event_id DESC) AS rn FROM (SELECT user_id, ts, event_id, CASE WHEN value > 70 THEN value END AS v FROM events)) WHERE rn = 1")
def dedupe_valid(spark, sf_dir):
    df = _users(spark, sf_dir).select("user_id", "ts", "event_id", F.when(F.col("value") > 70, F.col("value")).alias("v"))
    return U.dedupe_valid(df, ["user_id"], F.col("v").isNotNull(), ["ts", "event_id"])


@query("group_last", "SELECT event_type AS k, strftime(ts, '%Y-%m-%d %H:00:00+00:00') AS time_tag, arg_max(a, (ts, event_id)) FILTER (a IS NOT NULL) AS a, arg_max(b, (ts, event_id)) FILTER (b IS NOT NULL) AS b FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS a, CASE WHEN event_id % 4 = 0 THEN event_id END AS b FROM events) GROUP BY 1, 2")
def group_last(spark, sf_dir):
    df = keyed(spark, sf_dir).select(
        "k", "ts", "event_id", F.date_format("ts", "yyyy-MM-dd HH:00:00+00:00").alias("time_tag"),
        F.when(F.col("event_id") % 3 != 0, F.col("v")).alias("a"), F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("b"),
    )
    return U.group_last(df, ["k", "time_tag"], ["a", "b"], ["ts", "event_id"])


@query("high_water_mark", "WITH A AS (SELECT o_orderstatus AS source, greatest(max(o_orderdate), max(o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)))) AS t FROM orders GROUP BY 1), B AS (SELECT o_orderstatus, TIMESTAMP '2001-08-20' AS t FROM orders GROUP BY 1) SELECT source, greatest(A.t, B.t) AS latest_timestamp FROM A JOIN B ON B.o_orderstatus = A.source")
def high_water_mark(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("shipped", F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 40).cast("int")))
    seen = feeds.high_water_mark(o.withColumnRenamed("o_orderstatus", "source"), "source", ["o_orderdate", "shipped"])
    old = o.select(F.col("o_orderstatus").alias("source")).distinct().withColumn("latest_timestamp", F.lit("2001-08-20").cast("timestamp"))
    return feeds.advance_marks(old, seen, "source")


@query("source_breakdown", "SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'archive' END AS source_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def source_breakdown(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("source_type", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")))
    return feeds.source_breakdown(df, "ts")


@query("missing_counts", sql("SELECT count(*) FILTER (v IS NULL) AS v_missing, count(*) FILTER (i IS NULL) AS i_missing FROM G", "G"))
def missing_counts(spark, sf_dir):
    return Q.missing_counts(gridded(spark, sf_dir), ["v", "i"])


@query("require_complete", sql(f"SELECT k, ts, {s6('v')} AS v FROM H", "H"))
def require_complete(spark, sf_dir):
    return rounded(Q.require_complete(hourly(spark, sf_dir).drop("n"), ["v", "k", "ts"]), "v")


@query("count_onsets", sql(
    "SELECT k, count(DISTINCT o) AS n_onsets FROM (SELECT DISTINCT g.k, g.ts + to_hours(CAST(ceil(date_diff('microsecond', g.ts, o.ts) / 3600000000.0::DOUBLE) AS INTEGER)) AS o FROM G g JOIN (SELECT event_type AS k, ts FROM events WHERE value > 95) o ON o.k = g.k AND o.ts > g.ts AND o.ts <= g.ts + INTERVAL 8 HOUR) GROUP BY k", "G"))
def onsets(spark, sf_dir):
    at = table(spark, sf_dir, "events").filter("value > 95").select(F.col("event_type").alias("k"), F.col("ts").alias("o"))
    return count_onsets(hazard_labels(gridded(spark, sf_dir).select("k", "ts"), at, keys=["k"], ts="ts", onset="o"), keys=["k"], ts="ts")
