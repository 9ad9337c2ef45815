"""Merges, overlays, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormline.functions.lookup import KP_TO_AP, kp_to_ap
from stormline.operators import joins as J
from stormline.operators import upsert as U
from stormline.operators.chunks import micros
from stormline.operators.events import interval_labels
from stormline.operators.fill import asof_join, exact_then_ffill
from stormline.operators.quality import temporal_split
from stormline.operators.segments import crossings
from stormline.session import shared_folder

from .fixtures import dst, feed, gridded, hourly, kp, r6, rounded, table, wide
from .registry import query
from .registry import r6 as s6
from .registry import sql
from .rows import _CASE, WINDOWS


def _split(df):
    return temporal_split(df, "ts", WINDOWS)


_MERGED = sql(
    f"""SELECT * FROM (SELECT ts, CASE {_CASE} END AS split, {s6('w.bz')} AS imf_bz, {s6('w.speed')} AS imf_speed, {s6('dst')} AS dst_dst, {s6('kp')} AS kp_kp, {s6('a.v')} AS flux_v, {s6('b.v')} AS xray_v, n AS ssn_n
        FROM WIDE w JOIN DST USING (ts) JOIN KP USING (ts) JOIN FEED_A a USING (ts) JOIN FEED_B b USING (ts) JOIN (SELECT ts, n FROM H WHERE k = 'signup') USING (ts)) WHERE split IS NOT NULL""",
    "WIDE", "DST", "KP", "FEED_A", "FEED_B")


def _six_feeds(spark, sf_dir):
    frames = {
        "imf": rounded(wide(spark, sf_dir).select("ts", "bz", "speed"), "bz", "speed"),
        "dst": rounded(dst(spark, sf_dir), "dst"),
        "kp": rounded(kp(spark, sf_dir), "kp"),
        "flux": rounded(feed(spark, sf_dir, "click"), "v"),
        "xray": rounded(feed(spark, sf_dir, "view"), "v"),
        "ssn": hourly(spark, sf_dir).filter("k = 'signup'").select("ts", "n"),
    }
    return {n: _split(df) for n, df in frames.items()}


@query("merge_features", _MERGED)
def merge_features(spark, sf_dir):
    return J.merge_features(_six_feeds(spark, sf_dir), ["split", "ts"])


@query("merge_bucketed", _MERGED)
def merge_bucketed(spark, sf_dir):
    """The six feeds as bucketed tables, merged without an exchange."""
    folder, on = shared_folder(spark), ["split", "ts"]
    names = {n: f"six_{folder[-32:]}_{n}" for n in ("imf", "dst", "kp", "flux", "xray", "ssn")}
    for n, df in _six_feeds(spark, sf_dir).items():
        J.write_bucketed(df, names[n], on, path=f"{folder}/{n}")
    return J.merge_bucketed(names, on, spark)


@query("join_labels", sql(
    f"SELECT h.k, h.ts, {s6('h.v')} AS v, y FROM H h JOIN (SELECT event_type AS k, date_trunc('hour', ts) AS ts, CAST(max(value) > 90 AS INTEGER) AS y FROM events GROUP BY 1, 2) l ON l.k = h.k AND l.ts = h.ts", "H"))
def join_labels(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    late = events.select(F.col("event_type").alias("k"), (F.date_trunc("hour", "ts") + F.expr("INTERVAL 7 MINUTES")).alias("ts"), "value")
    labels = late.groupBy("k", "ts").agg((F.max("value") > 90).cast("int").alias("y"))
    return J.join_labels(rounded(hourly(spark, sf_dir).drop("n"), "v"), labels, keys=["k"], ts="ts", floor="hour")


@query("outer_join_hour", sql(
    f"""SELECT coalesce(a.ts, b.ts) AS ts, {s6('a.v')} AS a, {s6('b.v')} AS b, coalesce(CAST(CASE WHEN a.v IS NOT NULL THEN 1 END AS INTEGER), 0) AS a_source_id, coalesce(CAST(CASE WHEN b.v IS NOT NULL THEN 2 END AS INTEGER), 0) AS b_source_id
        FROM (SELECT * FROM FEED_A WHERE v > 40) a FULL JOIN (SELECT * FROM FEED_B WHERE v < 60) b ON a.ts = b.ts""", "FEED_A", "FEED_B"))
def outer_join_hour(spark, sf_dir):
    a = feed(spark, sf_dir, "click").filter("v > 40").select("ts", r6("v").alias("a"), F.lit(1).alias("a_source_id"))
    b = feed(spark, sf_dir, "view").filter("v < 60").select("ts", r6("v").alias("b"), F.lit(2).alias("b_source_id"))
    return J.outer_join_hour(a, b, ["ts"])


@query("common_hours", sql(f"SELECT a.ts, {s6('a.v')} AS v FROM FEED_A a WHERE a.ts IN (SELECT ts FROM FEED_B WHERE v > 50)", "FEED_A", "FEED_B"))
def common_hours(spark, sf_dir):
    b = feed(spark, sf_dir, "view").filter("v > 50")
    return rounded(J.common_rows(feed(spark, sf_dir, "click"), b, ["ts"]), "v")


@query("combine_priority", sql(
    f"""SELECT coalesce(p.ts, s.ts) AS ts, {s6('coalesce(p.v, s.v)')} AS v, CAST(CASE WHEN p.v IS NOT NULL THEN 2 WHEN s.v IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS v_source_id
        FROM (SELECT * FROM FEED_A WHERE ts >= TIMESTAMP '2024-01-08') p FULL JOIN (SELECT * FROM FEED_B WHERE ts < TIMESTAMP '2024-01-25') s ON p.ts = s.ts""", "FEED_A", "FEED_B"))
def combine_priority(spark, sf_dir):
    primary = feed(spark, sf_dir, "click").filter(F.col("ts") >= F.lit("2024-01-08").cast("timestamp"))
    secondary = feed(spark, sf_dir, "view").filter(F.col("ts") < F.lit("2024-01-25").cast("timestamp"))
    return rounded(U.combine_priority(primary, secondary, ["ts"], ["v"]), "v")


def _overlap(spark, sf_dir):
    old = feed(spark, sf_dir, "click").filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp")).withColumn("source_type", F.lit("archive"))
    new = feed(spark, sf_dir, "view").filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    return rounded(old, "v"), rounded(new, "v")


_OV = {
    "L": f"SELECT ts, {s6('v')} AS v FROM FEED_A WHERE ts < TIMESTAMP '2024-01-20'",
    "R": f"SELECT ts, {s6('v')} AS v FROM FEED_B WHERE ts >= TIMESTAMP '2024-01-10'",
}


@query("update_cells", sql("SELECT L.ts, coalesce(R.v, L.v) AS v, CASE WHEN R.ts IS NULL THEN 'archive' ELSE 'realtime' END AS source_type FROM L LEFT JOIN R ON R.ts = L.ts", "FEED_A", "FEED_B", **_OV))
def update_cells(spark, sf_dir):
    return U.overlay(*_overlap(spark, sf_dir), ["ts"], ["v"], mark=("source_type", "realtime"))


@query("fill_cells", sql("SELECT L.ts, coalesce(L.v, R.v) AS v, 'archive' AS source_type FROM L LEFT JOIN R ON R.ts = L.ts", "FEED_A", "FEED_B", **_OV))
def fill_cells(spark, sf_dir):
    return U.overlay(*_overlap(spark, sf_dir), ["ts"], ["v"], fill_only=True)


@query("update_append", sql("SELECT coalesce(L.ts, R.ts) AS ts, coalesce(R.v, L.v) AS v, CASE WHEN R.ts IS NULL THEN 'archive' ELSE 'realtime' END AS source_type FROM L FULL JOIN R ON R.ts = L.ts", "FEED_A", "FEED_B", **_OV))
def update_append(spark, sf_dir):
    return U.overlay(*_overlap(spark, sf_dir), ["ts"], ["v"], append=True, mark=("source_type", "realtime"))


@query("backfill_dedupe", sql("SELECT coalesce(L.ts, R.ts) AS ts, CASE WHEN R.ts IS NULL THEN L.v ELSE R.v END AS v FROM L FULL JOIN R ON R.ts = L.ts", "FEED_A", "FEED_B", **_OV))
def backfill_dedupe(spark, sf_dir):
    archive, realtime = _overlap(spark, sf_dir)
    return U.upsert_replace(archive.drop("source_type"), realtime, ["ts"])


@query("dual_channel", sql(f"SELECT coalesce(a.ts, b.ts) AS ts, {s6('a.v')} AS v1, {s6('b.v')} AS v2, {s6('a.v / nullif(b.v, 0)')} AS ratio FROM (SELECT * FROM FEED_A WHERE v > 30) a FULL JOIN (SELECT ts, greatest(v - 40, 0) AS v FROM FEED_B WHERE v < 70) b ON a.ts = b.ts", "FEED_A", "FEED_B"))
def dual_channel(spark, sf_dir):
    b = feed(spark, sf_dir, "view").filter("v < 70").select("ts", F.greatest(F.col("v") - 40, F.lit(0.0)).alias("v"))
    return rounded(U.dual_channel(feed(spark, sf_dir, "click").filter("v > 30"), b, ["ts"], "v"), "v1", "v2", "ratio")


@query("asof_last_event", sql(
    "SELECT g.k, g.ts, e.event_id, date_diff('microsecond', e.ts, g.ts) / 3600000000.0::DOUBLE AS hours_since FROM G g ASOF LEFT JOIN (SELECT event_type AS k, ts, event_id FROM events WHERE value > 80) e ON e.k = g.k AND e.ts <= g.ts", "G"))
def asof_last_event(spark, sf_dir):
    big = table(spark, sf_dir, "events").filter("value > 80").select(
        F.col("event_type").alias("k"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("ts").cast("timestamp").alias("at")
    )
    df = asof_join(gridded(spark, sf_dir).select("k", "ts"), big, keys=["k"], ts="ts", cols=["event_id", "at"], chunk="5d")
    return df.select("k", "ts", "event_id", ((micros("ts") - micros("at")) / F.lit(3_600_000_000)).alias("hours_since"))


@query("exact_then_ffill", sql(
    "SELECT g.k, g.ts, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY g.k ORDER BY g.ts), 0) AS m FROM (SELECT k, ts FROM G) g LEFT JOIN E ON E.k = g.k AND E.ts = g.ts",
    "G", E="SELECT event_type AS k, CASE WHEN event_id % 2 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts, CAST(max(event_id) AS DOUBLE) AS m FROM events WHERE value > 80 GROUP BY 1, 2"))
def exact(spark, sf_dir):
    moved = F.when(F.col("event_id") % 2 == 0, F.date_trunc("hour", "ts")).otherwise(F.col("ts").cast("timestamp"))
    big = table(spark, sf_dir, "events").filter("value > 80").select(F.col("event_type").alias("k"), moved.alias("ts"), "event_id")
    at = big.groupBy("k", "ts").agg(F.max("event_id").cast("double").alias("m"))
    return exact_then_ffill(gridded(spark, sf_dir).select("k", "ts"), at, {"m": 0.0}, keys=["k"], ts="ts", chunk="5d")


@query("asof_prior_crossing", sql(
    "SELECT h.k, h.ts, x.ts AS crossing FROM (SELECT k, ts FROM H WHERE v > 70) h ASOF JOIN (SELECT k, ts FROM (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY ts) AS p FROM H) WHERE v <= 50 AND p > 50) x ON x.k = h.k AND x.ts <= h.ts", "H"))
def asof_prior_crossing(spark, sf_dir):
    h = hourly(spark, sf_dir)
    found = crossings(h, "v", 50.0, keys=["k"], ts="ts", chunk="5d").select("k", "ts", F.col("ts").alias("crossing"))
    return asof_join(h.filter("v > 70").select("k", "ts"), found, keys=["k"], ts="ts", cols=["crossing"], how="inner", chunk="5d")


@query("interval_labels", sql(
    "SELECT DISTINCT g.k, g.ts, CAST(ceil(date_diff('microsecond', g.ts, o.ts) / 3600000000.0::DOUBLE) AS INTEGER) AS h FROM G g JOIN (SELECT event_type AS k, ts FROM events WHERE value > 95) o ON o.k = g.k AND o.ts > g.ts AND o.ts <= g.ts + INTERVAL 8 HOUR", "G"))
def intervals(spark, sf_dir):
    onsets = table(spark, sf_dir, "events").filter("value > 95").select(F.col("event_type").alias("k"), F.col("ts").alias("o"))
    return interval_labels(gridded(spark, sf_dir).select("k", "ts"), onsets, keys=["k"], ts="ts", onset="o")


_LONG = "SELECT ts, h, 1.0 / (1 + exp((60 - v + h) / 10)) AS p FROM (SELECT i, ts, v FROM G WHERE k = 'click' AND v IS NOT NULL), (SELECT unnest(range(1, 9)) AS h) WHERE v > 5 * h"
_HS = range(1, 9)


def _long(spark, sf_dir):
    g = gridded(spark, sf_dir).filter("k = 'click' AND v IS NOT NULL")
    spread = g.withColumn("h", F.explode(F.array(*[F.lit(h) for h in _HS]))).filter("v > 5 * h")
    return spread.select("ts", "h", (1.0 / (1 + F.exp((60 - F.col("v") + F.col("h")) / 10))).alias("p"))


_PIVOT = "SELECT ts, " + ", ".join(f"max(p) FILTER (h = {h}) AS p_h{h}" for h in _HS) + " FROM L GROUP BY ts"
_PS = [f"p_h{h}" for h in _HS]


@query("pivot_horizons", sql(f"SELECT ts, {', '.join(f'{s6(p)} AS {p}' for p in _PS)} FROM P", "G", L=_LONG, P=_PIVOT))
def pivot_horizons(spark, sf_dir):
    return rounded(J.pivot_horizons(_long(spark, sf_dir), on=["ts"], horizon="h", value="p", horizons=_HS), *_PS)


@query("merge_horizons_inner", sql(f"SELECT ts, {', '.join(f'{s6(p)} AS {p}' for p in _PS)} FROM P WHERE {' AND '.join(f'{p} IS NOT NULL' for p in _PS)}", "G", L=_LONG, P=_PIVOT))
def merge_horizons_inner(spark, sf_dir):
    return rounded(J.pivot_horizons(_long(spark, sf_dir), on=["ts"], horizon="h", value="p", horizons=_HS, complete=True), *_PS)


@query("cumulative_prob", sql(f"SELECT ts, {s6('1 - ' + ' * '.join(f'(1 - coalesce({p}, 0))' for p in _PS))} AS p_cumulative FROM P", "G", L=_LONG, P=_PIVOT))
def cumulative_prob(spark, sf_dir):
    wide_p = J.pivot_horizons(_long(spark, sf_dir), on=["ts"], horizon="h", value="p", horizons=_HS)
    return wide_p.select("ts", r6(J.cumulative_probability(_PS)).alias("p_cumulative"))


_NEAR = "list_min(list_transform([{0}], lambda e: {{'d': abs(round(value / 10, 2) - e.k), 'k': e.k, 'v': e.v}})).v".format(
    ", ".join(f"{{'k': {k}::DOUBLE, 'v': {v}::DOUBLE}}" for k, v in KP_TO_AP.items()))


@query("nearest_lookup", f"SELECT event_id, {_NEAR} AS ap FROM (SELECT event_id, floor(value) AS value FROM events)")
def nearest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", kp_to_ap(F.floor("value").cast("double") / 10).alias("ap"))
