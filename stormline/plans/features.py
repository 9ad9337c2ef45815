"""Domain features per feed, on keyed frames.

Every function takes `keys` (the series, and `split` when windows must restart at split borders),
the time column and the chunk width.  `step` says that rows lie on a regular grid; without it row
lags are taken on row positions, so rows that were filtered away are spanned, not counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormline.functions.lookup import AP_LEVEL, KP_REGIME, bucket_right_closed, kp_to_ap
from stormline.operators import rolling as R
from stormline.operators.chunks import POS, Span, micros
from stormline.operators.fill import carry
from stormline.operators.quality import clip_high, clip_low, finite
from stormline.operators.resample import ceil_time, floor_time, grid, on_grid, reindex_ffill
from stormline.operators.segments import previous_row
from stormline.operators.upsert import dedupe_last

PROTON_MASS = 1.6726219e-27
DECAY_TAU_HOURS = 36.0
XRAY_EPS = 1e-12
FLUX_EPS = 1e-6
NEVER_HOURS = 1e6
HOUR_US = 3_600_000_000


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _differences(df: DataFrame, cols: dict[str, str], *, keys, ts, chunk, lags: dict[str, str] | None = None) -> DataFrame:
    """new name -> column: value minus the preceding row's; `lags` adds the preceding values themselves."""
    lags = lags or {}
    wanted = {f"_p_{c}": c for c in dict.fromkeys([*cols.values(), *lags.values()])}
    df = previous_row(df, wanted, keys=keys, ts=ts, chunk=chunk).drop(POS)
    df = df.withColumns({
        **{n: F.col(c) - F.col(f"_p_{c}") for n, c in cols.items()},
        **{n: F.col(f"_p_{c}") for n, c in lags.items()},
    })
    return df.drop(*wanted)


def imf_coupling(df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "30d") -> DataFrame:
    """Clock angle, coupling rate, reconnection field, dynamic pressure and change of bz."""
    v, n, bt, by, bz = (F.col(c) for c in ("speed", "density", "bt", "by", "bz"))
    clock = F.atan2(by, bz)
    newell = F.pow(v, 4.0 / 3.0) * F.pow(bt, 2.0 / 3.0) * F.pow(F.abs(F.sin(clock / 2.0)), 8.0 / 3.0)
    df = df.withColumns({
        "clock_angle": _zero(clock),
        "newell_dphi_dt": _zero(finite(newell)),
        "ey": _zero(-v * bz),
        "dynamic_pressure": _zero(n * PROTON_MASS * F.pow(v * 1e3, F.lit(2.0)) * 1e9),
    })
    df = _differences(df, {"delta_bz": "bz"}, keys=keys, ts=ts, chunk=chunk)
    return df.withColumn("delta_bz", _zero(F.col("delta_bz")))


def imf_windows(df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "30d") -> DataFrame:
    out = R.rolling(
        df,
        {
            "bz_min_6h": R.lowest("bz", span="6h", min_periods=3),
            "bz_south_frac_6h": R.fraction(F.col("bz") < 0, span="6h", min_periods=3),
            "newell_int_6h": R.total("newell_dphi_dt", span="6h", min_periods=3),
            "ey_mean_6h": R.mean("ey", span="6h", min_periods=3),
            "pdyn_max_6h": R.highest("dynamic_pressure", span="6h", min_periods=3),
        },
        keys=keys, ts=ts, chunk=chunk,
    )
    return out.dropna("any", subset=[
        "bz", "newell_dphi_dt", "ey", "dynamic_pressure", "bz_min_6h", "bz_south_frac_6h", "newell_int_6h", "ey_mean_6h", "pdyn_max_6h",
    ])


def dst_features(df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "30d", col: str = "dst") -> DataFrame:
    rolled = R.rolling(
        df.select(*keys, ts, F.col(col).alias("dst")),
        {"dst_mean_6h": R.mean("dst", span="6h"), "dst_std_6h": R.std_pop("dst", span="6h")},
        keys=keys, ts=ts, chunk=chunk,
    )
    out = _differences(rolled, {"dst_derivative": "dst"}, keys=keys, ts=ts, chunk=chunk)
    return out.withColumns({c: _zero(F.col(c)) for c in ("dst_std_6h", "dst_derivative")})


def _six_hours(df: DataFrame, col: str, rolled: dict, *, keys, ts, chunk, step) -> DataFrame:
    columns = {f"{col}_{n}_6h": a for n, a in rolled.items()}
    out = R.rolling(df, {**columns, "_six": R.shifted(col, rows=6)}, keys=keys, ts=ts, chunk=chunk, step=step)
    out = out.withColumn(f"{col}_delta_6h", F.col(col) - F.col("_six")).drop("_six")
    return out.dropna("any")


def dst_windows(df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "30d", step: Span | None = None) -> DataFrame:
    """Six-hour aggregates of `dst`; rows whose windows are not covered drop out."""
    rolled = {
        "min": R.lowest("dst", span="6h", min_periods=3),
        "mean": R.mean("dst", span="6h", min_periods=3),
        "slope": R.slope("dst", span="6h", min_periods=3),
        "neg_frac": R.fraction(F.col("dst") < 0, span="6h", min_periods=3),
    }
    return _six_hours(df, "dst", rolled, keys=keys, ts=ts, chunk=chunk, step=step)


def kp_features(df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "30d", col: str = "kp") -> DataFrame:
    """ap by nearest table value, its regime and level buckets and its change from the row before."""
    rows = df.filter(F.col(col).isNotNull()).select(*keys, ts, F.col(col).alias("kp")).withColumn("ap", kp_to_ap(F.col("kp")))
    rows = _differences(rows, {"ap_3h_change": "ap"}, keys=keys, ts=ts, chunk=chunk)
    return rows.select(
        *keys, ts, "ap",
        bucket_right_closed(F.col("kp"), KP_REGIME).alias("kp_regime"),
        _zero(F.col("ap_3h_change")).alias("ap_3h_change"),
        bucket_right_closed(F.col("ap"), AP_LEVEL).alias("ap_level_bucket"),
    )


def kp_windows(df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "30d", step: Span | None = None) -> DataFrame:
    """Six-hour aggregates of `kp`; rows whose windows are not covered drop out."""
    rolled = {
        "max": R.highest("kp", span="6h", min_periods=3),
        "mean": R.mean("kp", span="6h", min_periods=3),
        "ge5_frac": R.fraction(F.col("kp") >= 5.0, span="6h", min_periods=3),
        "slope": R.slope("kp", span="6h", min_periods=3),
    }
    return _six_hours(df, "kp", rolled, keys=keys, ts=ts, chunk=chunk, step=step)


def ssn_features(
    df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "365d", step: Span | None = None, col: str = "ssn",
    trend_rows: int = 648, mean_rows: int = 1944,
) -> DataFrame:
    """Level, compressed level, trend per day over 27 days of rows and distance from the 81-day row mean."""
    base = df.select(*keys, ts, F.col(col).alias("ssn"))
    rolled = R.rolling(
        base, {"_lag": R.shifted("ssn", rows=trend_rows), "_mean": R.wide_mean("ssn", rows=mean_rows)}, keys=keys, ts=ts, chunk=chunk, step=step
    )
    ssn = F.col("ssn")
    return rolled.select(
        *keys, ts,
        _zero(finite(ssn)).alias("ssn"),
        _zero(finite(F.log1p(clip_low(ssn, 0.0)))).alias("log_ssn"),
        _zero(finite((ssn - F.col("_lag")) / 27.0)).alias("ssn_slope_27d"),
        _zero(finite(ssn - F.col("_mean"))).alias("ssn_anomaly_81d"),
    )


def ssn_windows(
    df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "810d", step: Span | None = None, hours: int = 1944, trend_rows: int = 1296,
    min_periods: int | None = None,
) -> DataFrame:
    """Mean and spread over 81 days, trend over 54 days of rows, share of rows above the mean."""
    need = R.half_coverage(hours) if min_periods is None else min_periods
    first = R.rolling(
        df,
        {
            f"ssn_mean_{hours}h": R.wide_mean("ssn", span=f"{hours}h", min_periods=need),
            f"ssn_std_{hours}h": R.wide_std_samp("ssn", span=f"{hours}h", min_periods=need),
            "_lag": R.shifted("ssn", rows=trend_rows),
        },
        keys=keys, ts=ts, chunk=chunk, step=step,
    )
    above = F.col("ssn") > F.col(f"ssn_mean_{hours}h")
    second = R.rolling(
        first, {f"ssn_anomaly_frac_{hours}h": R.wide_fraction(above, span=f"{hours}h", min_periods=need)}, keys=keys, ts=ts, chunk=chunk
    )
    out = second.withColumn(f"ssn_trend_{trend_rows}h", (F.col("ssn") - F.col("_lag")) / (trend_rows / 24.0)).drop("_lag")
    out = out.withColumn(f"ssn_std_{hours}h", _zero(F.col(f"ssn_std_{hours}h")))
    names = [f"ssn_mean_{hours}h", f"ssn_std_{hours}h", f"ssn_trend_{trend_rows}h", f"ssn_anomaly_frac_{hours}h"]
    return out.withColumns({c: finite(F.col(c)) for c in names}).dropna("any", subset=["ssn", *names])


def flux_features(
    df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "60d", col: str = "adjusted_flux", rotation_rows: int = 648
) -> DataFrame:
    """Held on the hourly grid (only samples on the full hour are seen), then log, 24-row change, 27-day anomaly."""
    held = reindex_ffill(df.select(*keys, ts, F.col(col).alias("f107")), ["f107"], keys=keys, ts=ts, chunk=chunk)
    rolled = R.rolling(
        held, {"_day": R.shifted("f107", rows=24), "_mean": R.wide_mean("f107", rows=rotation_rows, min_periods=24)},
        keys=keys, ts=ts, chunk=chunk, step="1h",
    )
    f107 = F.col("f107")
    return rolled.select(
        *keys, ts,
        _zero(f107).alias("f107"),
        _zero(F.log(clip_low(f107, FLUX_EPS))).alias("log_f107"),
        _zero(f107 - F.col("_day")).alias("df107_24h"),
        _zero(f107 - F.col("_mean")).alias("f107_anomaly_27d"),
    )


def flux_windows(df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "30d") -> DataFrame:
    out = R.rolling(
        df,
        {
            "f107_mean_24h": R.mean("f107", span="24h", min_periods=12),
            "_day": R.shifted("f107", rows=24),
            "f107_std_72h": R.std_pop("f107", span="72h", min_periods=36),
            "log_f107_mean_24h": R.mean("log_f107", span="24h", min_periods=12),
            "_mean72": R.wide_mean("f107", span="72h", min_periods=36),
        },
        keys=keys, ts=ts, chunk=chunk, step="1h",
    )
    out = out.withColumns({"f107_delta_24h": F.col("f107") - F.col("_day"), "f107_anomaly_72h": F.col("f107") - F.col("_mean72")})
    names = ["f107", "log_f107", "f107_mean_24h", "f107_delta_24h", "f107_std_72h", "log_f107_mean_24h", "f107_anomaly_72h"]
    return out.drop("_day", "_mean72").dropna("any", subset=names)


def xray_features(df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "30d", a: str = "irradiance_xrsa", b: str = "irradiance_xrsb") -> DataFrame:
    """Log fluxes, their ratio, hourly change and lag of both channels; missing becomes 0."""
    logs = df.select(
        *keys, ts, F.log10(F.col(b) + XRAY_EPS).alias("log_xrsb"), F.log10(F.col(a) + XRAY_EPS).alias("log_xrsa")
    ).withColumns({"xrs_hardness": F.col("log_xrsb") - F.col("log_xrsa"), "xrsa_to_xrsb_ratio_log": F.col("log_xrsa") - F.col("log_xrsb")})
    out = _differences(
        logs, {"dlog_xrsb_1h": "log_xrsb", "dlog_xrsa_1h": "log_xrsa"}, keys=keys, ts=ts, chunk=chunk,
        lags={"log_xrsb_lag_1h": "log_xrsb", "log_xrsa_lag_1h": "log_xrsa"},
    )
    names = [c for c in out.columns if c not in (*keys, ts)]
    return out.withColumns({c: _zero(finite(F.col(c))) for c in names})


def xray_windows(df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "30d", rise: float = 0.3) -> DataFrame:
    columns: dict[str, R.Agg] = {}
    for ch in ("xrsb", "xrsa"):
        v = f"log_{ch}"
        columns |= {
            f"{v}_mean_6h": R.mean(v, span="6h", min_periods=3),
            f"{v}_max_24h": R.highest(v, span="24h", min_periods=12),
            f"{v}_slope_6h": R.slope(v, span="6h", min_periods=3, strict=True),
            f"_{v}_low": R.lowest(v, span="24h", min_periods=12),
            f"hrs_since_rapid_rise_{ch}_24h": R.since_true(F.col(f"d{v}_1h") > rise, span="24h"),
        }
    out = R.rolling(df, columns, keys=keys, ts=ts, chunk=chunk)
    out = out.withColumns({f"log_{ch}_peak_to_bg_24h": F.col(f"log_{ch}") - F.col(f"_log_{ch}_low") for ch in ("xrsb", "xrsa")})
    return out.drop("_log_xrsb_low", "_log_xrsa_low").dropna("any")


def cme_event_features(df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "365d", order: str = "event_id") -> DataFrame:
    """Speed against the previous event, overtaking flag, strength, shock proxy and width towards the observer."""
    events = dedupe_last(df.filter(F.col("median_velocity").isNotNull()), [*keys, ts], [order])
    seen = previous_row(events, {"prev_cme_v_med": "median_velocity"}, keys=keys, ts=ts, chunk=chunk).drop(POS)
    v, width = F.col("median_velocity"), F.col("angular_width")
    ratio = v / clip_low(F.col("prev_cme_v_med"), 1.0)
    facing = F.cos(F.radians("position_angle"))
    return seen.withColumns({
        "last_cme_speed_ratio": ratio,
        "cme_overtaking_flag": F.coalesce(ratio > 1.5, F.lit(False)).cast("int"),
        "strength": v * width,
        "shock_proxy": v * (F.col("velocity_variation") / clip_low(v, 1.0)),
        "effective_width": width * clip_high(clip_low(facing, 0.0), 1.0),
    })


def cme_hourly(events: DataFrame, *, keys: Sequence[str], ts: str, as_of: str | None = None, chunk: Span = "30d") -> DataFrame:
    """Events on the hourly grid from the first event's hour to the later of the last event and `as_of`.

    Hours since the last event and the 24-hour strength sum see every event; the "last" columns only
    take events exactly on the hour, and hold them.
    """
    columns = {"last_cme_v_med": "median_velocity", "effective_width": "effective_width", "cme_overtaking_flag": "cme_overtaking_flag",
               "last_cme_shock_proxy": "shock_proxy"}
    events = events.select(*keys, ts, "strength", *columns.values())
    ends = events.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    last = ceil_time("_b", "1h")
    if as_of is not None:
        last = F.greatest(last, F.lit(as_of).cast("timestamp"))
    times = grid(ends.select(*keys, floor_time("_a", "1h").alias("lo"), last.alias("hi")), keys=keys, ts=ts, step="1h")
    hourly = on_grid(events.select(*keys, ts, "strength"), {"_s": _zero(F.sum("strength"))}, keys=keys, ts=ts, step="1h", times=times)
    hourly = R.rolling(hourly, {"cme_strength_sum_24h": R.total("_s", rows=24)}, keys=keys, ts=ts, chunk=chunk, step="1h").drop("_s")

    # events and grid hours in one sequence, an event before the hour it falls on
    on_hour = micros(ts) == micros(floor_time(ts, "1h"))
    met = events.select(*keys, ts, F.lit(0).alias("_side"), F.col(ts).alias("_at"), *[F.when(on_hour, F.col(c)).alias(n) for n, c in columns.items()])
    both = hourly.withColumn("_side", F.lit(1)).unionByName(met, allowMissingColumns=True)
    held = carry(both, keys=keys, ts=ts, forward={"_at": "_at", **{n: n for n in columns}}, chunk=chunk, order=["_side"]).filter("_side = 1")
    hours = F.coalesce((micros(ts) - micros("_at")) / F.lit(HOUR_US), F.lit(NEVER_HOURS))
    out = held.withColumns({"hours_since_last_cme": hours, **{n: F.coalesce(F.col(n), F.lit(0)) for n in columns}})
    return out.withColumn("cme_influence_exp", F.exp(-F.col("hours_since_last_cme") / DECAY_TAU_HOURS)).drop("_side", "_at")


def cme_windows(df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "30d") -> DataFrame:
    columns = {
        "min_hours_since_last_cme_6h": R.lowest("hours_since_last_cme", span="6h", min_periods=3),
        "max_last_cme_v_med_12h": R.highest("last_cme_v_med", span="12h", min_periods=6),
        "mean_cme_influence_exp_12h": R.mean("cme_influence_exp", span="12h", min_periods=6),
        "max_last_cme_shock_proxy_6h": R.highest("last_cme_shock_proxy", span="6h", min_periods=3),
    }
    out = R.rolling(df, columns, keys=keys, ts=ts, chunk=chunk)
    return out.withColumns({c: finite(F.col(c)) for c in columns}).dropna("any", subset=list(columns))


def disturbed_flag(df: DataFrame, *, keys: Sequence[str], ts: str, chunk: Span = "30d", step: Span | None = "1h", bz_low=-6.0, coupling=2.0e4, fast=600.0, squeeze=4.0, required: int = 2) -> DataFrame:
    """True where at least `required` of four conditions hold: southward field, strong coupling, fast wind, compression."""
    rolled = R.rolling(
        df,
        {
            "_s": R.total(F.coalesce(F.col("bz") <= bz_low, F.lit(False)).cast("int"), rows=2, min_periods=2),
            "_c": R.total("newell_dphi_dt", rows=3, min_periods=3),
            "_f": R.total(F.coalesce(F.col("speed") >= fast, F.lit(False)).cast("int"), rows=2, min_periods=2),
            "_p": R.shifted("dynamic_pressure", rows=1),
        },
        keys=keys, ts=ts, chunk=chunk, step=step,
    )
    held = [F.col("_s") >= 2, F.col("_c") > coupling, F.col("_f") >= 2, F.col("dynamic_pressure") - F.col("_p") > squeeze]
    count = sum((F.coalesce(h, F.lit(False)).cast("int") for h in held), F.lit(0))
    return rolled.withColumn("disturbed", count >= required).drop("_s", "_c", "_f", "_p")
