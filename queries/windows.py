"""Trailing windows, lags, fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormline.operators import rolling as R
from stormline.operators.fill import carry
from stormline.operators.segments import gap_hours

from .fixtures import daily, gridded, r6, rounded
from .registry import query
from .registry import r6 as s6
from .registry import sql

SIX = "OVER (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL '5 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)"
DAY24 = SIX.replace("'5 hours", "'23 hours")
ALL72 = SIX.replace("'5 hours", "'71 hours")
KEYED = {"keys": ["k"], "ts": "ts", "chunk": "10d"}


def _guard(agg: str, over: str, need: int) -> str:
    return s6(f"CASE WHEN count(v) {over} >= {need} THEN {agg} {over} END")


def _rolled(spark, sf_dir, columns, **more):
    df = R.rolling(gridded(spark, sf_dir).drop("i"), columns, **KEYED, **more)
    return rounded(df, "v", *columns)


@query("rolling_mean", sql(f"SELECT k, ts, {s6('v')} AS v, {_guard('avg(v)', SIX, 3)} AS mean_6h, {_guard('avg(v)', DAY24, 12)} AS mean_24h FROM G", "G"))
def rolling_mean(spark, sf_dir):
    return _rolled(spark, sf_dir, {"mean_6h": R.mean("v", span="6h", min_periods=3), "mean_24h": R.mean("v", span="24h", min_periods=12)})


@query("rolling_std_pop", sql(f"SELECT k, ts, {s6('v')} AS v, coalesce({_guard('stddev_pop(v)', SIX, 1)}, 0.0) AS std_6h, {_guard('stddev_pop(v)', ALL72, 36)} AS std_72h FROM G", "G"))
def rolling_std_pop(spark, sf_dir):
    df = _rolled(spark, sf_dir, {"std_6h": R.std_pop("v", span="6h"), "std_72h": R.std_pop("v", span="72h", min_periods=36)})
    return df.withColumn("std_6h", F.coalesce("std_6h", F.lit(0.0)))


_D81 = "OVER (ORDER BY ts RANGE BETWEEN INTERVAL '80 days 23 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)"


@query("rolling_std_samp", sql(f"SELECT ts, {s6('v')} AS v, coalesce({_guard('stddev_samp(v)', _D81, 41)}, 0.0) AS std_81d FROM DAY", "DAY"))
def rolling_std_samp(spark, sf_dir):
    df = R.rolling(daily(spark, sf_dir), {"std_81d": R.wide_std_samp("v", span="81d", min_periods=41)}, keys=[], ts="ts", chunk="810d")
    return rounded(df.withColumn("std_81d", F.coalesce("std_81d", F.lit(0.0))), "v", "std_81d")


@query("rolling_min", sql(f"SELECT k, ts, {_guard('min(v)', SIX, 3)} AS min_6h, {_guard('min(v)', DAY24, 12)} AS min_24h FROM G", "G"))
def rolling_min(spark, sf_dir):
    return _rolled(spark, sf_dir, {"min_6h": R.lowest("v", span="6h", min_periods=3), "min_24h": R.lowest("v", span="24h", min_periods=12)}).drop("v")


@query("rolling_max", sql(f"SELECT k, ts, {_guard('max(v)', SIX, 3)} AS max_6h, {_guard('max(v)', DAY24, 12)} AS max_24h FROM G", "G"))
def rolling_max(spark, sf_dir):
    return _rolled(spark, sf_dir, {"max_6h": R.highest("v", span="6h", min_periods=3), "max_24h": R.highest("v", span="24h", min_periods=12)}).drop("v")


_R24 = "OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


@query("rolling_sum", sql(f"SELECT k, ts, {_guard('sum(v)', SIX, 3)} AS sum_6h, {_guard('sum(v)', _R24, 1)} AS sum_24r FROM G", "G"))
def rolling_sum(spark, sf_dir):
    return _rolled(spark, sf_dir, {"sum_6h": R.total("v", span="6h", min_periods=3), "sum_24r": R.total("v", rows=24)}, step="1h").drop("v")


@query("rolling_frac", sql(f"SELECT k, ts, {s6(f'CASE WHEN count(*) {SIX} >= 3 THEN avg(CASE WHEN v > 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) {SIX} END')} AS frac_6h FROM G", "G"))
def rolling_frac(spark, sf_dir):
    return _rolled(spark, sf_dir, {"frac_6h": R.fraction(F.col("v") > 60, span="6h", min_periods=3)}).drop("v")


_N = "SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY ts) AS DOUBLE) AS x FROM G"


@query("rolling_slope", sql(f"SELECT k, ts, {s6(f'CASE WHEN count(v) {SIX} >= 3 THEN regr_slope(v, x) {SIX} END')} AS slope_6h FROM N", "G", N=_N))
def rolling_slope(spark, sf_dir):
    return _rolled(spark, sf_dir, {"slope_6h": R.slope("v", span="6h", min_periods=3)}).drop("v")


@query("rolling_slope_strict", sql(f"SELECT k, ts, {s6(f'CASE WHEN count(v) {SIX} >= 3 AND count(v) {SIX} = count(*) {SIX} THEN regr_slope(v, x) {SIX} END')} AS slope_6h FROM N", "G", N=_N))
def rolling_slope_strict(spark, sf_dir):
    return _rolled(spark, sf_dir, {"slope_6h": R.slope("v", span="6h", min_periods=3, strict=True)}).drop("v")


@query("since_last_true", sql(f"SELECT k, ts, x - max(CASE WHEN v > 60 THEN x END) {DAY24} AS rows_since FROM N", "G", N=_N))
def since_last_true(spark, sf_dir):
    return _rolled(spark, sf_dir, {"rows_since": R.since_true(F.col("v") > 60, span="24h")}).drop("v")


_W = "OVER (PARTITION BY k ORDER BY ts)"


@query("lag_diff", sql(f"SELECT k, ts, {s6(f'coalesce(v - lag(v) {_W}, 0.0)')} AS diff_1, {s6(f'v - lag(v, 6) {_W}')} AS diff_6, {s6(f'lag(v, 24) {_W}')} AS lag_24 FROM G", "G"))
def lag_diff(spark, sf_dir):
    df = R.rolling(gridded(spark, sf_dir), {"p1": R.shifted("v", rows=1), "p6": R.shifted("v", rows=6), "lag_24": R.shifted("v", rows=24)}, **KEYED, step="1h")
    return df.select("k", "ts", r6(F.coalesce(F.col("v") - F.col("p1"), F.lit(0.0))).alias("diff_1"), r6(F.col("v") - F.col("p6")).alias("diff_6"), r6("lag_24").alias("lag_24"))


def _rows_over(n: int) -> str:
    return f"OVER (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("rolling_anomaly", sql(f"SELECT ts, {s6(f'v - CASE WHEN count(v) {_rows_over(648)} >= 24 THEN avg(v) {_rows_over(648)} END')} AS anomaly_648, {s6(f'v - avg(v) {_rows_over(1944)}')} AS anomaly_1944 FROM DAY", "DAY"))
def rolling_anomaly(spark, sf_dir):
    df = R.rolling(daily(spark, sf_dir), {"m648": R.wide_mean("v", rows=648, min_periods=24), "m1944": R.wide_mean("v", rows=1944)}, keys=[], ts="ts", chunk="365d")
    return df.select("ts", r6(F.col("v") - F.col("m648")).alias("anomaly_648"), r6(F.col("v") - F.col("m1944")).alias("anomaly_1944"))


@query("rolling_centered", sql(f"SELECT ts, {s6('avg(v) OVER (ORDER BY ts ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)')} AS mean_365 FROM DAY", "DAY"))
def rolling_centered(spark, sf_dir):
    df = R.rolling(daily(spark, sf_dir), {"mean_365": R.centred_mean("v", rows=365)}, keys=[], ts="ts", chunk="365d", chunk_rows=1000)
    return rounded(df.drop("v"), "mean_365")


@query("min_periods", sql(f"SELECT k, ts, {_guard('avg(v)', SIX, 1)} AS need_1, {_guard('avg(v)', SIX, 3)} AS need_3, {_guard('avg(v)', SIX, 6)} AS need_6 FROM G", "G"))
def min_periods(spark, sf_dir):
    return _rolled(spark, sf_dir, {f"need_{n}": R.mean("v", span="6h", min_periods=n) for n in (1, 3, 6)}).drop("v")


@query("peak_to_background", sql(f"SELECT k, ts, {s6(f'v - CASE WHEN count(v) {DAY24} >= 12 THEN min(v) {DAY24} END')} AS above_24h FROM G", "G"))
def peak_to_background(spark, sf_dir):
    df = R.rolling(gridded(spark, sf_dir), {"low": R.lowest("v", span="24h", min_periods=12)}, **KEYED)
    return df.select("k", "ts", r6(F.col("v") - F.col("low")).alias("above_24h"))


@query("ffill_bfill", sql(f"""SELECT k, ts, {s6('last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS forward,
    {s6('first_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS backward FROM G""", "G"))
def ffill_bfill(spark, sf_dir):
    df = carry(gridded(spark, sf_dir), keys=["k"], ts="ts", forward={"forward": "v"}, backward={"backward": "v"}, chunk="5d")
    return rounded(df.select("k", "ts", "forward", "backward"), "forward", "backward")


@query("gap_hours", sql(f"SELECT k, ts, coalesce(date_diff('second', lag(ts) OVER (PARTITION BY k ORDER BY ts), ts) / 3600.0::DOUBLE, 0.0) AS gap_hours FROM G WHERE v IS NOT NULL", "G"))
def gaps(spark, sf_dir):
    return gap_hours(gridded(spark, sf_dir), "v", keys=["k"], ts="ts", chunk="5d").select("k", "ts", "gap_hours")
