"""Domain features per feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormline.functions.lookup import KP_TO_AP
from stormline.operators.fill import interpolate_both
from stormline.operators.quality import temporal_split
from stormline.operators.segments import flag_intervals
from stormline.plans import features as D

from .fixtures import catalogue, daily, dst, feed, gridded, kp, r6, rounded, table, wide
from .registry import query
from .registry import r3 as s3
from .registry import r6 as s6
from .registry import sql
from .rows import _CASE, WINDOWS
from .segments import _INTERP, _PN

ONE = {"keys": [], "ts": "ts", "chunk": "5d"}
_O = "OVER (ORDER BY ts)"


def last(hours: int, by: str = "") -> str:
    return f"OVER ({by} ORDER BY ts RANGE BETWEEN INTERVAL '{hours - 1} hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)"


def rows(n: int, by: str = "") -> str:
    return f"OVER ({by} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def need(agg: str, col: str, over: str, n: int) -> str:
    return f"CASE WHEN count({col}) {over} >= {n} THEN {agg} {over} END"


def listed(*cols: str) -> str:
    return ", ".join(f"{(s3 if c.startswith('newell') else s6)(c)} AS {c.strip(chr(34))}" for c in cols)


def _out(df, *exact):
    large = [c for c in df.columns if c.startswith("newell")]
    df, exact = df.withColumns({c: F.round(F.col(c) + F.lit(3.7e-7), 3) + F.lit(0.0) for c in large}), (*exact, *large)
    return rounded(df, *[f.name for f in df.schema.fields if f.dataType.typeName() == "double" and f.name not in exact])


# --- the end-to-end slice: events -> hourly grid -> gap repair -> split -> windows -------------

_SP = "PARTITION BY k, split"


@query("dst_features_split", sql(
    f"""SELECT k, ts, split, {s6('v')} AS dst, {s6(f'avg(v) {last(6, _SP)}')} AS dst_mean_6h, {s6(f'coalesce(stddev_pop(v) {last(6, _SP)}, 0)')} AS dst_std_6h,
        {s6(f'coalesce(v - lag(v) OVER ({_SP} ORDER BY ts), 0)')} AS dst_derivative FROM S""",
    "G", PN=_PN, F=_INTERP, S=f"SELECT * FROM (SELECT k, ts, f AS v, CASE {_CASE} END AS split FROM F) WHERE split IS NOT NULL"))
def dst_features_split(spark, sf_dir):
    repaired = interpolate_both(gridded(spark, sf_dir).drop("i"), "v", keys=["k"], ts="ts", limit=3, step="1h", chunk="10d")
    split = temporal_split(repaired, "ts", WINDOWS)
    return _out(D.dst_features(split, keys=["k", "split"], ts="ts", chunk="10d", col="v"))


@query("dst_features", sql(
    f"""SELECT ts, {s6('dst')} AS dst, {s6(f'avg(dst) {last(6)}')} AS dst_mean_6h, {s6(f'coalesce(stddev_pop(dst) {last(6)}, 0)')} AS dst_std_6h,
        {s6(f'coalesce(dst - lag(dst) {_O}, 0)')} AS dst_derivative FROM DST""", "DST"))
def dst_features(spark, sf_dir):
    return _out(D.dst_features(dst(spark, sf_dir), **ONE))


_X = "SELECT *, CAST(row_number() OVER (ORDER BY ts) AS DOUBLE) AS x FROM "


@query("dst_windows", sql(
    f"""SELECT ts, {listed('dst', 'dst_min_6h', 'dst_mean_6h', 'dst_slope_6h', 'dst_neg_frac_6h', 'dst_delta_6h')} FROM (SELECT ts, dst,
        {need('min(dst)', 'dst', last(6), 3)} AS dst_min_6h, {need('avg(dst)', 'dst', last(6), 3)} AS dst_mean_6h, {need('regr_slope(dst, x)', 'dst', last(6), 3)} AS dst_slope_6h,
        {need('avg(CASE WHEN dst < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', '*', last(6), 3)} AS dst_neg_frac_6h, dst - lag(dst, 6) {_O} AS dst_delta_6h FROM X)
        WHERE dst_min_6h IS NOT NULL AND dst_delta_6h IS NOT NULL AND dst_slope_6h IS NOT NULL""", "DST", X=_X + "DST"))
def dst_windows(spark, sf_dir):
    return _out(D.dst_windows(dst(spark, sf_dir), **ONE))


_AP = "list_min(list_transform([{0}], lambda e: {{'d': abs(round_even(kp, 2) - e.k), 'k': e.k, 'v': e.v}})).v".format(
    ", ".join(f"{{'k': {k}::DOUBLE, 'v': {v}::DOUBLE}}" for k, v in KP_TO_AP.items()))


def _bucket(col: str, bounds) -> str:
    return "CASE " + " ".join(f"WHEN {col} <= {b} THEN {i}" for i, b in enumerate(bounds)) + f" WHEN {col} IS NOT NULL THEN {len(bounds)} END"


@query("kp_features", sql(
    f"SELECT ts, ap, CAST({_bucket('kp', (2, 4, 6))} AS INTEGER) AS kp_regime, coalesce(ap - lag(ap) {_O}, 0.0::DOUBLE) AS ap_3h_change, CAST({_bucket('ap', (10, 30, 80, 200))} AS INTEGER) AS ap_level_bucket FROM A",
    "KP", A=f"SELECT ts, kp, {_AP} AS ap FROM KP"))
def kp_features(spark, sf_dir):
    return D.kp_features(kp(spark, sf_dir), **ONE)


@query("kp_windows", sql(
    f"""SELECT ts, {listed('kp', 'kp_max_6h', 'kp_mean_6h', 'kp_slope_6h', 'kp_ge5_frac_6h', 'kp_delta_6h')} FROM (SELECT ts, kp,
        {need('max(kp)', 'kp', last(6), 3)} AS kp_max_6h, {need('avg(kp)', 'kp', last(6), 3)} AS kp_mean_6h, {need('regr_slope(kp, x)', 'kp', last(6), 3)} AS kp_slope_6h,
        {need('avg(CASE WHEN kp >= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', '*', last(6), 3)} AS kp_ge5_frac_6h, kp - lag(kp, 6) {_O} AS kp_delta_6h FROM X)
        WHERE kp_max_6h IS NOT NULL AND kp_delta_6h IS NOT NULL AND kp_slope_6h IS NOT NULL""", "KP", X=_X + "KP"))
def kp_windows(spark, sf_dir):
    return _out(D.kp_windows(kp(spark, sf_dir), **ONE))


@query("ssn_features", sql(
    f"""SELECT ts, {s6('v')} AS ssn, {s6('ln(1 + CASE WHEN v < 0 THEN 0 ELSE v END)')} AS log_ssn, {s6(f'coalesce((v - lag(v, 648) {_O}) / 27, 0)')} AS ssn_slope_27d,
        {s6(f'v - avg(v) {rows(1944)}')} AS ssn_anomaly_81d FROM DAY""", "DAY"))
def ssn_features(spark, sf_dir):
    return _out(D.ssn_features(daily(spark, sf_dir), keys=[], ts="ts", chunk="365d", col="v"))


@query("ssn_windows", sql(
    f"""SELECT ts, {listed('ssn', 'ssn_mean_1944h', 'ssn_std_1944h', 'ssn_trend_54h', 'ssn_anomaly_frac_1944h')} FROM (SELECT ts, ssn, ssn_mean_1944h, coalesce(sd, 0) AS ssn_std_1944h,
        (ssn - lag(ssn, 54) {_O}) / 2.25 AS ssn_trend_54h, {need('avg(CASE WHEN ssn > ssn_mean_1944h THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', '*', last(1944), 41)} AS ssn_anomaly_frac_1944h
        FROM (SELECT ts, v AS ssn, {need('avg(v)', 'v', last(1944), 41)} AS ssn_mean_1944h, {need('stddev_samp(v)', 'v', last(1944), 41)} AS sd FROM DAY))
        WHERE ssn_mean_1944h IS NOT NULL AND ssn_trend_54h IS NOT NULL AND ssn_anomaly_frac_1944h IS NOT NULL""", "DAY"))
def ssn_windows(spark, sf_dir):
    df = daily(spark, sf_dir).withColumnRenamed("v", "ssn")
    return _out(D.ssn_windows(df, keys=[], ts="ts", chunk="810d", trend_rows=54, min_periods=41))


_FLUX = {
    "FX": "SELECT o_orderdate AS ts, max(o_totalprice) / 1000 AS v FROM orders GROUP BY 1",
    "FG": "SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM FX",
    "FH": "SELECT ts, last_value(v IGNORE NULLS) OVER (ORDER BY ts) AS v FROM FG LEFT JOIN FX USING (ts)",
    "FF": f"""SELECT ts, coalesce(v, 0) AS f107, coalesce(ln(CASE WHEN v < 1e-6 THEN 1e-6 ELSE v END), 0) AS log_f107, coalesce(v - lag(v, 24) {_O}, 0) AS df107_24h,
        coalesce(v - {need('avg(v)', 'v', rows(648), 24)}, 0) AS f107_anomaly_27d FROM FH""",
}


def _flux(spark, sf_dir):
    daily_peak = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("timestamp").alias("ts"))
    return D.flux_features(daily_peak.agg((F.max("o_totalprice") / 1000).alias("adjusted_flux")), keys=[], ts="ts", chunk="270d")


@query("flux_features", sql(f"SELECT ts, {listed('f107', 'log_f107', 'df107_24h', 'f107_anomaly_27d')} FROM FF", **_FLUX))
def flux_features(spark, sf_dir):
    return _out(_flux(spark, sf_dir))


@query("flux_windows", sql(
    f"""SELECT ts, {listed('f107', 'log_f107', 'df107_24h', 'f107_anomaly_27d', 'f107_mean_24h', 'f107_delta_24h', 'f107_std_72h', 'log_f107_mean_24h', 'f107_anomaly_72h')} FROM (SELECT *,
        {need('avg(f107)', 'f107', last(24), 12)} AS f107_mean_24h, f107 - lag(f107, 24) {_O} AS f107_delta_24h, {need('stddev_pop(f107)', 'f107', last(72), 36)} AS f107_std_72h,
        {need('avg(log_f107)', 'log_f107', last(24), 12)} AS log_f107_mean_24h, f107 - {need('avg(f107)', 'f107', last(72), 36)} AS f107_anomaly_72h FROM FF)
        WHERE f107_mean_24h IS NOT NULL AND f107_delta_24h IS NOT NULL AND f107_std_72h IS NOT NULL""", **_FLUX))
def flux_windows(spark, sf_dir):
    return _out(D.flux_windows(_flux(spark, sf_dir), keys=[], ts="ts", chunk="90d"))


_XR = "SELECT a.ts, a.v * 1e-7 AS a, b.v * 1e-6 AS b FROM FEED_A a JOIN FEED_B b USING (ts)"
_XL = """SELECT ts, coalesce(log10(b + 1e-12), 0) AS log_xrsb, coalesce(log10(a + 1e-12), 0) AS log_xrsa,
    coalesce(log10(b + 1e-12) - log10(a + 1e-12), 0) AS xrs_hardness, coalesce(log10(a + 1e-12) - log10(b + 1e-12), 0) AS xrsa_to_xrsb_ratio_log,
    coalesce(log10(b + 1e-12) - lag(log10(b + 1e-12)) OVER (ORDER BY ts), 0) AS dlog_xrsb_1h, coalesce(log10(a + 1e-12) - lag(log10(a + 1e-12)) OVER (ORDER BY ts), 0) AS dlog_xrsa_1h,
    coalesce(lag(log10(b + 1e-12)) OVER (ORDER BY ts), 0) AS log_xrsb_lag_1h, coalesce(lag(log10(a + 1e-12)) OVER (ORDER BY ts), 0) AS log_xrsa_lag_1h FROM XR"""
_XCOLS = ["log_xrsb", "log_xrsa", "xrs_hardness", "xrsa_to_xrsb_ratio_log", "dlog_xrsb_1h", "dlog_xrsa_1h", "log_xrsb_lag_1h", "log_xrsa_lag_1h"]


def _xray(spark, sf_dir):
    a = feed(spark, sf_dir, "click").select("ts", (F.col("v") * 1e-7).alias("irradiance_xrsa"))
    b = feed(spark, sf_dir, "view").select("ts", (F.col("v") * 1e-6).alias("irradiance_xrsb"))
    return D.xray_features(a.join(b, "ts"), **ONE)


@query("xray_features", sql(f"SELECT ts, {listed(*_XCOLS)} FROM XL", "FEED_A", "FEED_B", XR=_XR, XL=_XL))
def xray_features(spark, sf_dir):
    return _out(_xray(spark, sf_dir))


def _xw(ch: str) -> str:
    v = f"log_{ch}"
    return f"""{need(f'avg({v})', v, last(6), 3)} AS {v}_mean_6h, {need(f'max({v})', v, last(24), 12)} AS {v}_max_24h,
        CASE WHEN count({v}) {last(6)} >= 3 AND count({v}) {last(6)} = count(*) {last(6)} THEN regr_slope({v}, x) {last(6)} END AS {v}_slope_6h,
        {v} - {need(f'min({v})', v, last(24), 12)} AS {v}_peak_to_bg_24h, x - max(CASE WHEN d{v}_1h > 0.3 THEN x END) {last(24)} AS hrs_since_rapid_rise_{ch}_24h"""


_XWCOLS = [f"log_{c}_{n}" for c in ("xrsb", "xrsa") for n in ("mean_6h", "max_24h", "slope_6h", "peak_to_bg_24h")]


@query("xray_windows", sql(
    f"""SELECT ts, {listed(*_XCOLS, *_XWCOLS)}, hrs_since_rapid_rise_xrsb_24h, hrs_since_rapid_rise_xrsa_24h FROM (SELECT *, {_xw('xrsb')}, {_xw('xrsa')} FROM X)
        WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*_XWCOLS, 'hrs_since_rapid_rise_xrsb_24h', 'hrs_since_rapid_rise_xrsa_24h'])}""",
    "FEED_A", "FEED_B", XR=_XR, XL=_XL, X=_X + "XL"))
def xray_windows(spark, sf_dir):
    return _out(D.xray_windows(_xray(spark, sf_dir), **ONE), "hrs_since_rapid_rise_xrsb_24h", "hrs_since_rapid_rise_xrsa_24h")


_CE = """SELECT *, v / CASE WHEN p < 1 THEN 1 ELSE p END AS ratio, coalesce(CAST(v / CASE WHEN p < 1 THEN 1 ELSE p END > 1.5 AS INTEGER), 0) AS cme_overtaking_flag, v * angular_width AS strength,
    v * (velocity_variation / CASE WHEN v < 1 THEN 1 ELSE v END) AS shock_proxy, angular_width * greatest(0, least(1, cos(radians(position_angle)))) AS effective_width
    FROM (SELECT *, median_velocity AS v, lag(median_velocity) OVER (ORDER BY ts) AS p FROM CAT0)"""
# the catalogue's events are moved to the full hour when their id is even, so that both alignments occur
_CAT0 = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts, median_velocity, angular_width, position_angle, velocity_variation FROM CAT"
_CAT1 = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY event_id DESC) AS rn FROM ({_CAT0})) WHERE rn = 1"


def _events(spark, sf_dir):
    moved = F.when(F.col("event_id") % 2 == 0, F.date_trunc("hour", "ts")).otherwise(F.col("ts"))
    return D.cme_event_features(catalogue(spark, sf_dir).withColumn("ts", moved), keys=[], ts="ts", chunk="5d")


@query("cme_event_features", sql(f"SELECT event_id, ts, {s6('ratio')} AS last_cme_speed_ratio, cme_overtaking_flag, {listed('strength', 'shock_proxy', 'effective_width')} FROM CE", "CAT", CAT0=_CAT1, CE=_CE))
def cme_event_features(spark, sf_dir):
    df = _events(spark, sf_dir).select("event_id", "ts", "last_cme_speed_ratio", "cme_overtaking_flag", "strength", "shock_proxy", "effective_width")
    return _out(df)


_AS_OF = "2024-01-31 06:00:00"
_CG = f"SELECT unnest(generate_series(date_trunc('hour', min(ts)), greatest(date_trunc('hour', max(ts)) + INTERVAL 1 HOUR, TIMESTAMP '{_AS_OF}'), INTERVAL 1 HOUR)) AS ts FROM CE"
_CS = "SELECT date_trunc('hour', ts) AS ts, sum(strength) AS s FROM CE GROUP BY 1"
_CX = """SELECT g.ts, coalesce(s, 0) AS s, e.v AS v, e.effective_width AS w, e.cme_overtaking_flag AS o, e.shock_proxy AS q, a.ts AS last FROM CG g LEFT JOIN CS ON CS.ts = g.ts LEFT JOIN CE e ON e.ts = g.ts ASOF LEFT JOIN CE a ON a.ts <= g.ts"""
_HELD = "coalesce(last_value({0} IGNORE NULLS) OVER (ORDER BY ts), 0)"
_CH = f"""SELECT ts, coalesce(date_diff('microsecond', last, ts) / 3600000000.0::DOUBLE, 1e6) AS hours_since_last_cme, sum(s) {rows(24)} AS cme_strength_sum_24h,
    {_HELD.format('v')} AS last_cme_v_med, {_HELD.format('w')} AS effective_width, {_HELD.format('o')} AS cme_overtaking_flag, {_HELD.format('q')} AS last_cme_shock_proxy FROM CX"""
_CI = "SELECT *, exp(-hours_since_last_cme / 36) AS cme_influence_exp FROM CH"
_CMECOLS = ["hours_since_last_cme", "cme_strength_sum_24h", "last_cme_v_med", "effective_width", "last_cme_shock_proxy", "cme_influence_exp"]
_CME = {"CAT0": _CAT1, "CE": _CE, "CG": _CG, "CS": _CS, "CX": _CX, "CH": _CH, "CI": _CI}


def _cme(spark, sf_dir):
    return D.cme_hourly(_events(spark, sf_dir), keys=[], ts="ts", as_of=_AS_OF, chunk="5d")


@query("cme_hourly", sql(f"SELECT ts, cme_overtaking_flag, {listed(*_CMECOLS)} FROM CI", "CAT", **_CME))
def cme_hourly(spark, sf_dir):
    return _out(_cme(spark, sf_dir))


_CWCOLS = ["min_hours_since_last_cme_6h", "max_last_cme_v_med_12h", "mean_cme_influence_exp_12h", "max_last_cme_shock_proxy_6h"]


@query("cme_windows", sql(
    f"""SELECT ts, cme_overtaking_flag, {listed(*_CMECOLS, *_CWCOLS)} FROM (SELECT *, {need('min(hours_since_last_cme)', '*', last(6), 3)} AS min_hours_since_last_cme_6h,
        {need('max(last_cme_v_med)', '*', last(12), 6)} AS max_last_cme_v_med_12h, {need('avg(cme_influence_exp)', '*', last(12), 6)} AS mean_cme_influence_exp_12h,
        {need('max(last_cme_shock_proxy)', '*', last(6), 3)} AS max_last_cme_shock_proxy_6h FROM CI) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _CWCOLS)}""", "CAT", **_CME))
def cme_windows(spark, sf_dir):
    return _out(D.cme_windows(_cme(spark, sf_dir), **ONE))


_IMF = f"""SELECT ts, "by", bz, bx, bt, speed, density, coalesce(atan2("by", bz), 0) AS clock_angle,
    coalesce(pow(speed, 4.0 / 3.0) * pow(bt, 2.0 / 3.0) * pow(abs(sin(atan2("by", bz) / 2)), 8.0 / 3.0), 0) AS newell_dphi_dt, coalesce(-speed * bz, 0) AS ey,
    coalesce(density * 1.6726219e-27 * pow(speed * 1e3, 2) * 1e9, 0) AS dynamic_pressure, coalesce(bz - lag(bz) {_O}, 0) AS delta_bz FROM WIDE"""
_IMFCOLS = ["bz", "clock_angle", "newell_dphi_dt", "ey", "dynamic_pressure", "delta_bz"]


def _imf(spark, sf_dir):
    return D.imf_coupling(wide(spark, sf_dir), **ONE)


@query("imf_coupling", sql(f"SELECT ts, {listed(*_IMFCOLS)} FROM I", "WIDE", I=_IMF))
def imf_coupling(spark, sf_dir):
    return _out(_imf(spark, sf_dir).select("ts", *_IMFCOLS))


_IWCOLS = ["bz_min_6h", "bz_south_frac_6h", "newell_int_6h", "ey_mean_6h", "pdyn_max_6h"]


@query("imf_windows", sql(
    f"""SELECT ts, {listed(*_IMFCOLS, *_IWCOLS)} FROM (SELECT *, {need('min(bz)', 'bz', last(6), 3)} AS bz_min_6h, {need('avg(CASE WHEN bz < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', '*', last(6), 3)} AS bz_south_frac_6h,
        {need('sum(newell_dphi_dt)', '*', last(6), 3)} AS newell_int_6h, {need('avg(ey)', '*', last(6), 3)} AS ey_mean_6h, {need('max(dynamic_pressure)', '*', last(6), 3)} AS pdyn_max_6h FROM I)
        WHERE bz IS NOT NULL AND bz_min_6h IS NOT NULL AND bz_south_frac_6h IS NOT NULL""", "WIDE", I=_IMF))
def imf_windows(spark, sf_dir):
    return _out(D.imf_windows(_imf(spark, sf_dir), **ONE).select("ts", *_IMFCOLS, *_IWCOLS))


_DIST = f"""SELECT ts, CAST(coalesce(sum(CAST(coalesce(bz <= -6, FALSE) AS INTEGER)) {rows(2)} >= 2 AND count(*) {rows(2)} = 2, FALSE) AS INTEGER)
    + CAST(coalesce(count(newell_dphi_dt) {rows(3)} = 3 AND sum(newell_dphi_dt) {rows(3)} > 9e4, FALSE) AS INTEGER)
    + CAST(coalesce(sum(CAST(coalesce(speed >= 560, FALSE) AS INTEGER)) {rows(2)} >= 2, FALSE) AS INTEGER) + CAST(coalesce(dynamic_pressure - lag(dynamic_pressure) {_O} > 2, FALSE) AS INTEGER) >= 2 AS disturbed FROM I"""


def _disturbed(spark, sf_dir):
    flagged = D.disturbed_flag(_imf(spark, sf_dir), **ONE, step=None, coupling=9e4, fast=560.0, squeeze=2.0)
    return flagged.select("ts", "disturbed")


@query("disturbed_flag", sql(_DIST, "WIDE", I=_IMF))
def disturbed_flag(spark, sf_dir):
    return _disturbed(spark, sf_dir)


@query("disturbed_pct", sql(f"SELECT {s6('avg(CAST(disturbed AS INTEGER)) * 100')} AS pct FROM D", "WIDE", I=_IMF, D=_DIST))
def disturbed_pct(spark, sf_dir):
    return _disturbed(spark, sf_dir).agg(r6(F.avg(F.col("disturbed").cast("int")) * 100).alias("pct"))


@query("disturbed_intervals", sql(
    f"""SELECT start, coalesce(nxt, last) AS "end" FROM (SELECT disturbed, min(ts) AS start, max(ts) AS last, lead(min(ts)) OVER (ORDER BY seg) AS nxt
        FROM (SELECT *, sum(turn) {_O} AS seg FROM (SELECT *, CASE WHEN disturbed IS DISTINCT FROM lag(disturbed) {_O} OR lag(ts) {_O} IS NULL THEN 1 ELSE 0 END AS turn FROM D2)) GROUP BY seg, disturbed) WHERE disturbed""",
    "WIDE", I=_IMF, D=_DIST, D2="SELECT * FROM D WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-29'"))
def disturbed_intervals(spark, sf_dir):
    df = _disturbed(spark, sf_dir).filter((F.col("ts") >= F.lit("2024-01-03").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-29").cast("timestamp")))
    return flag_intervals(df, F.col("disturbed"), **ONE)
