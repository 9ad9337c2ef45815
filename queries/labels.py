"""Onsets, spacing, labels, storm intervals, prominent peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormline.functions.lookup import KP_TO_AP, kp_to_ap
from stormline.operators import events as E
from stormline.operators.segments import prominent_peaks

from .fixtures import dst, gridded, hourly, kp, table
from .registry import query
from .registry import sql

ONE = {"keys": [], "ts": "ts", "chunk": "5d"}
_AP = "list_min(list_transform([{0}], lambda e: {{'d': abs(round_even(kp, 2) - e.k), 'k': e.k, 'v': e.v}})).v".format(
    ", ".join(f"{{'k': {k}::DOUBLE, 'v': {v}::DOUBLE}}" for k, v in KP_TO_AP.items()))
_STORM = {
    "I": f"SELECT DST.ts, dst, {_AP} AS ap, lag(dst) OVER (ORDER BY DST.ts) AS p FROM DST JOIN KP ON KP.ts = DST.ts",
    "C": "SELECT ts FROM I WHERE dst <= 0 AND p > 0",
    "R": "SELECT *, sum(turn) OVER (ORDER BY ts) AS seg FROM (SELECT *, CASE WHEN storm IS DISTINCT FROM lag(storm) OVER (ORDER BY ts) OR lag(ts) OVER (ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS turn FROM (SELECT *, ap > 39 AND dst < -50 AS storm FROM I))",
    "S": "SELECT min(ts) AS start, arg_min(ts, (dst, ts)) AS low FROM R WHERE storm GROUP BY seg",
}


def _index(spark, sf_dir):
    return dst(spark, sf_dir).join(kp(spark, sf_dir).select("ts", kp_to_ap(F.col("kp")).alias("ap")), "ts")


def _storm():
    return (F.col("ap") > 39) & (F.col("dst") < -50)


@query("storm_onsets", sql("SELECT C.ts AS onset FROM S ASOF JOIN C ON C.ts <= S.start", "DST", "KP", **_STORM))
def storm_onsets(spark, sf_dir):
    return E.storm_onsets(_index(spark, sf_dir), "dst", _storm(), **ONE)


_GREEDY = {
    "Q": "SELECT k, ts FROM H WHERE v > 60",
    "N": "SELECT a.k, a.ts, min(b.ts) AS nxt FROM Q a LEFT JOIN Q b ON b.k = a.k AND b.ts >= a.ts + INTERVAL 4 HOUR GROUP BY a.k, a.ts",
    "K": "SELECT k, min(ts) AS ts FROM Q GROUP BY k UNION ALL SELECT K.k, N.nxt FROM K JOIN N ON N.k = K.k AND N.ts = K.ts WHERE N.nxt IS NOT NULL",
}


@query("greedy_spacing", sql("SELECT k, ts FROM K", "H", **_GREEDY).replace("WITH ", "WITH RECURSIVE ", 1))
def greedy_spacing(spark, sf_dir):
    high = hourly(spark, sf_dir).filter("v > 60").select("k", "ts")
    return E.greedy_spacing(high, keys=["k"], ts="ts", gap="4h", chunk="3d")


_HITS = "SELECT g.k, g.ts, ceil(date_diff('microsecond', g.ts, o.ts) / 3600000000.0::DOUBLE) AS h FROM G g LEFT JOIN (SELECT event_type AS k, ts FROM events WHERE value > 95) o ON o.k = g.k AND o.ts > g.ts AND o.ts <= g.ts + INTERVAL 8 HOUR"


@query("hazard_labels", sql("SELECT k, ts, " + ", ".join(f"CAST(coalesce(bool_or(h = {h}), FALSE) AS INTEGER) AS h_{h}" for h in range(1, 9)) + " FROM X GROUP BY k, ts", "G", X=_HITS))
def hazard_labels(spark, sf_dir):
    onsets = table(spark, sf_dir, "events").filter("value > 95").select(F.col("event_type").alias("k"), F.col("ts").alias("o"))
    return E.hazard_labels(gridded(spark, sf_dir).select("k", "ts"), onsets, keys=["k"], ts="ts", onset="o")


@query("storm_intervals", sql(
    """SELECT min(start) AS start, max(low) AS "end" FROM (SELECT *, sum(o) OVER (ORDER BY start, low) AS g FROM (SELECT *, CASE WHEN start <= max(low) OVER (ORDER BY start, low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS o
        FROM (SELECT DISTINCT coalesce(C.ts, S.start) AS start, low FROM S ASOF LEFT JOIN C ON C.ts <= S.start))) GROUP BY g""", "DST", "KP", **_STORM))
def storm_intervals(spark, sf_dir):
    return E.storm_intervals(_index(spark, sf_dir), "dst", _storm(), **ONE)


_PEAKS = {
    "Z": "SELECT k, ts, floor(v / 5) * 5 AS v FROM H",
    "R": "SELECT *, sum(turn) OVER (PARTITION BY k ORDER BY ts) AS seg FROM (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY k ORDER BY ts) THEN 1 ELSE 0 END AS turn FROM Z)",
    "J": "SELECT k, seg, v, min(ts) AS a, max(ts) AS b, list(ts ORDER BY ts)[(count(*) + 1) // 2] AS ts FROM R GROUP BY k, seg, v",
    "T": "SELECT * FROM (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM J WINDOW w AS (PARTITION BY k ORDER BY seg)) WHERE pv < v AND nv < v",
    "U": """SELECT T.*, (SELECT max(z.ts) FROM Z z WHERE z.k = T.k AND z.ts < T.a AND z.v > T.v) AS lo, (SELECT min(z.ts) FROM Z z WHERE z.k = T.k AND z.ts > T.b AND z.v > T.v) AS hi FROM T""",
}


@query("prominent_peaks", sql(
    """SELECT k, ts, v FROM (SELECT U.k, U.ts, U.v, (SELECT min(z.v) FROM Z z WHERE z.k = U.k AND z.ts <= U.a AND (U.lo IS NULL OR z.ts > U.lo)) AS l,
        (SELECT min(z.v) FROM Z z WHERE z.k = U.k AND z.ts >= U.b AND (U.hi IS NULL OR z.ts < U.hi)) AS r FROM U) WHERE v - greatest(l, r) >= 39""", "H", **_PEAKS))
def peaks(spark, sf_dir):
    coarse = hourly(spark, sf_dir).select("k", "ts", (F.floor(F.col("v") / 5) * 5).cast("double").alias("v"))
    return prominent_peaks(coarse, "v", keys=["k"], ts="ts", prominence=39.0, chunk="3d")
