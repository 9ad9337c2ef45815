"""Runs, crossings, intervals, peaks, gaps and their repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormline.operators import quality as Q
from stormline.operators import segments as S
from stormline.operators.fill import interpolate_both

from .fixtures import feed, gridded, hourly, r6, rounded, table
from .registry import query
from .registry import r6 as s6
from .registry import sql

KEYED = {"keys": ["k"], "ts": "ts", "chunk": "5d"}
_BY = "PARTITION BY k ORDER BY ts"
_TURN = f"SELECT *, sum(turn) OVER ({_BY}) AS seg FROM (SELECT k, ts, v, on_, CASE WHEN on_ IS DISTINCT FROM lag(on_) OVER ({_BY}) OR lag(ts) OVER ({_BY}) IS NULL THEN 1 ELSE 0 END AS turn FROM A)"


@query("run_segments", sql(
    "SELECT k, ts, CAST(seg AS BIGINT) AS seg, min(ts) OVER (PARTITION BY k, seg) AS seg_start, count(*) OVER (PARTITION BY k, seg) AS seg_len FROM R",
    "G", A="SELECT *, v IS NULL AS on_ FROM G", R=_TURN))
def run_segments(spark, sf_dir):
    return S.run_segments(gridded(spark, sf_dir), F.col("v").isNull(), **KEYED).select("k", "ts", "seg", "seg_start", "seg_len")


@query("zero_crossings", sql(f"SELECT k, ts, {s6('v')} AS v FROM (SELECT *, lag(v) OVER ({_BY}) AS p FROM H) WHERE v <= 50 AND p > 50", "H"))
def zero_crossings(spark, sf_dir):
    return rounded(S.crossings(hourly(spark, sf_dir).drop("n"), "v", 50.0, **KEYED), "v")


@query("flag_intervals", sql(
    """SELECT k, start, coalesce(nxt, last) AS "end" FROM (SELECT k, on_, min(ts) AS start, max(ts) AS last,
        lead(min(ts)) OVER (PARTITION BY k ORDER BY seg) AS nxt FROM R GROUP BY k, on_, seg) WHERE on_""",
    "H", A="SELECT *, v > 50 AS on_ FROM H", R=_TURN))
def flag_intervals(spark, sf_dir):
    return S.flag_intervals(hourly(spark, sf_dir), F.col("v") > 50, **KEYED)


@query("local_peaks", sql(
    f"""SELECT k, ts, {s6('v')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY k, seg ORDER BY ts) AS j, count(*) OVER (PARTITION BY k, seg) AS len FROM R) x
        JOIN (SELECT k, seg, lag(any_value(on_)) OVER (PARTITION BY k ORDER BY seg) AS a, lead(any_value(on_)) OVER (PARTITION BY k ORDER BY seg) AS b FROM R GROUP BY k, seg) y USING (k, seg)
        WHERE a < v AND b < v AND j = (len + 1) // 2 AND v >= 50""",
    "H", A="SELECT k, ts, floor(v / 10) * 10 AS v, floor(v / 10) * 10 AS on_ FROM H", R=_TURN))
def local_peaks(spark, sf_dir):
    coarse = hourly(spark, sf_dir).select("k", "ts", (F.floor(F.col("v") / 10) * 10).cast("double").alias("v"))
    return rounded(S.local_peaks(coarse, "v", height=50.0, **KEYED), "v")


@query("missing_ranges", """WITH P AS (SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d FROM orders),
    X AS (SELECT s, p, CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT s, p FROM P)),
    M AS (SELECT * FROM X EXCEPT SELECT * FROM P)
    SELECT s, p, min(d) AS start, max(d) AS "end" FROM (SELECT s, p, d, d - CAST(row_number() OVER (PARTITION BY s, p ORDER BY d) AS INTEGER) AS g FROM M) GROUP BY s, p, g""")
def missing_ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("d"))
    days = F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-08-01").cast("date"))).alias("d")
    return S.missing_ranges(o.select("s", "p").distinct().select("s", "p", days), o, "d", keys=["s", "p"], chunk_days=365)


_PN = """SELECT k, ts, i, v, max(i) FILTER (v IS NOT NULL) OVER (PARTITION BY k ORDER BY ts) AS pi, min(i) FILTER (v IS NOT NULL) OVER (PARTITION BY k ORDER BY ts DESC) AS ni,
    last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts) AS pv, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts DESC) AS nv FROM G"""
_INTERP = """SELECT *, CASE WHEN v IS NOT NULL THEN v WHEN pi IS NOT NULL AND ni IS NOT NULL AND (i - pi <= 3 OR ni - i <= 3) THEN pv + (nv - pv) * (i - pi) / (ni - pi)
    WHEN ni IS NULL AND i - pi <= 3 THEN pv WHEN pi IS NULL AND ni - i <= 3 THEN nv END AS f FROM PN"""


@query("interp_limit_both", sql(f"SELECT k, ts, {s6('f')} AS v FROM F", "G", PN=_PN, F=_INTERP))
def interp_limit_both(spark, sf_dir):
    return rounded(interpolate_both(gridded(spark, sf_dir).drop("i"), "v", limit=3, step="1h", **KEYED), "v")


@query("impute_interp_close", sql(
    f"SELECT k, ts, {s6('coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts), nv, 0)')} AS v FROM F", "G", PN=_PN, F=_INTERP))
def impute_interp_close(spark, sf_dir):
    return rounded(interpolate_both(gridded(spark, sf_dir).drop("i"), "v", limit=3, step="1h", close=True, **KEYED), "v")


@query("impute_gap_rule", sql(
    f"""SELECT k, ts, {s6("CASE WHEN v IS NOT NULL THEN v WHEN len > 3 THEN 0 ELSE coalesce(pv + (nv - pv) * (i - pi) / (ni - pi), pv, nv) END")} AS v,
        CAST(v IS NULL AND len > 3 AS INTEGER) AS v_missing_flag
        FROM (SELECT *, coalesce(ni, max(i) OVER (PARTITION BY k) + 1) - coalesce(pi, -1) - 1 AS len FROM PN)""", "G", PN=_PN))
def impute_gap_rule(spark, sf_dir):
    return rounded(Q.impute_gap_rule(gridded(spark, sf_dir).drop("i"), ["v"], step="1h", **KEYED), "v")


@query("impute_zero", sql(f"SELECT k, ts, {s6('coalesce(v, 0)')} AS v FROM G", "G"))
def impute_zero(spark, sf_dir):
    return rounded(gridded(spark, sf_dir).drop("i").fillna(0.0, ["v"]), "v")


@query("xray_filter", sql(
    f"""SELECT ts, CAST(a IS NULL AND b IS NULL AS INTEGER) AS missing_flag, {s6("coalesce((fa + fb) / 2, fa, fb)")} AS irradiance
        FROM (SELECT *, CASE WHEN a <= 0 THEN 0 ELSE a END AS fa, CASE WHEN b <= 0 THEN 0 ELSE b END AS fb FROM P)""",
    "FEED_A", "FEED_B", P="SELECT a.ts, a.v - 40 AS a, b.v - 40 AS b FROM FEED_A a JOIN FEED_B b USING (ts)"))
def xray_filter(spark, sf_dir):
    a = feed(spark, sf_dir, "click").select("ts", (F.col("v") - 40).alias("a"))
    b = feed(spark, sf_dir, "view").select("ts", (F.col("v") - 40).alias("b"))
    both = a.join(b, "ts").withColumn("missing_flag", Q.all_missing_flag(["a", "b"]))
    cleaned = both.withColumns({c: Q.floor_clip(F.col(c), 0.0) for c in ("a", "b")})
    return cleaned.select("ts", "missing_flag", r6(Q.row_median(["a", "b"])).alias("irradiance"))
