"""The whole way from raw feeds to a forecast on a small fixture."""

import numpy as np
import pandas as pd
from helpers import START, collect, same, to_spark
from pyspark.sql import functions as F

from stormline.plans import stages as S
from stormline.plans.horizons import Trial
from stormline.session import materialise

WINDOWS = {
    "train": ("2024-01-01", "2024-01-20 23:59:59"), "validation": ("2024-01-21", "2024-01-25 23:59:59"), "test": ("2024-01-26", "2024-01-30"),
}


def feed(spark, seed, hours=720, every=60, **cols):
    rng = np.random.default_rng(seed)
    n = hours * 60 // every
    pdf = pd.DataFrame({"time_tag": START + pd.to_timedelta(np.arange(n) * every, unit="m")})
    for name, (mean, spread) in cols.items():
        pdf[name] = np.round(mean + spread * rng.normal(size=n), 2)
    return pdf, to_spark(spark, pdf)


def test_dst_stage_against_pandas(spark):
    pdf, df = feed(spark, 1, every=45, dst=(0, 40))
    pdf.loc[::7, "dst"] = np.nan
    got = collect(S.dst_stage(to_spark(spark, pdf), S.Plan(WINDOWS, chunk="3d")), "split", "time_tag")
    hourly = pdf.set_index("time_tag")["dst"]
    bins = pd.date_range(hourly.index.min().floor("h"), hourly.index.max().floor("h"), freq="h")
    at = hourly.index.searchsorted(bins, side="right") - 1
    hourly = pd.Series(hourly.to_numpy()[at], index=bins).dropna()
    want = []
    for split in sorted(WINDOWS):
        s = hourly[WINDOWS[split][0] : pd.Timestamp(WINDOWS[split][1])]
        s = s[s.index <= pd.Timestamp(WINDOWS[split][1])]
        want.append(pd.DataFrame({
            "dst": s, "mean": s.rolling("6h", min_periods=1).mean(), "std": s.rolling("6h", min_periods=1).std(ddof=0).fillna(0), "d": s.diff().fillna(0)
        }))
    want = pd.concat(want)
    assert list(got["time_tag"]) == list(want.index)
    for a, b in (("dst", "dst"), ("dst_mean_6h", "mean"), ("dst_std_6h", "std"), ("dst_derivative", "d")):
        same(got[a], want[b], 1e-7)


def test_raw_feeds_to_forecast(spark):
    plan = S.Plan(WINDOWS, chunk="10d", ssn_rows=(24, 48), ssn_hours=48, ssn_trend_rows=24, storm_dst=-20.0)
    raw = {
        "dst": feed(spark, 1, dst=(0, 40))[1], "kp": feed(spark, 2, every=180, kp_index=(4.5, 1.5))[1], "ssn": feed(spark, 3, every=1440, sunspot_number=(90, 20))[1],
        "flux": feed(spark, 4, every=360, adjusted_flux=(120, 10))[1],
        "pa": feed(spark, 5, every=20, density=(5, 1), speed=(450, 80), temperature=(9, 1))[1], "pb": feed(spark, 6, hours=400, density=(5, 1), speed=(450, 80), temperature=(9, 1))[1],
        "fa": feed(spark, 7, every=20, bx_gsm=(0, 3), by_gsm=(0, 3), bz_gsm=(0, 3), bt=(6, 1))[1], "fb": feed(spark, 8, hours=300, bx=(0, 3), by=(0, 3), bz=(0, 3), bt=(6, 1))[1],
        "xray": feed(spark, 9, every=10, irradiance_xrsa1=(1e-7, 1e-8), irradiance_xrsa2=(1e-7, 1e-8), irradiance_xrsb1=(1e-6, 1e-7), irradiance_xrsb2=(1e-6, 1e-7))[1],
    }
    cme = feed(spark, 10, every=333, median_velocity=(500, 100), angular_width=(60, 10), position_angle=(180, 90), velocity_variation=(50, 9))[1]
    cme = cme.withColumn("event_id", F.date_format("time_tag", "yyyyMMddHHmm"))
    features = {
        "dst": S.dst_stage(raw["dst"], plan), "kp": S.kp_stage(raw["kp"], plan), "sunspot": S.sunspot_stage(raw["ssn"], plan),
        "radio_flux": S.flux_stage(raw["flux"], plan), "cme": S.cme_stage(cme, plan),
        "imf_solar_wind": S.field_stage(raw["pa"], raw["pb"], raw["fa"], raw["fb"], plan),
    }
    matrix = S.design_matrix(features, plan)
    labels = S.label_stage(raw["dst"], raw["kp"], plan)
    data = materialise(S.labelled(matrix, labels, plan))
    counts = {r["split"]: r["count"] for r in data.groupBy("split").count().collect()}
    assert set(counts) == set(WINDOWS) and data.select("split", "time_tag").distinct().count() == data.count()
    assert not [c for c in data.columns if c != "split" and data.filter(F.col(c).isNull()).limit(1).count()]
    by = S.train(data, [1, 2], plan, coarse=[Trial(2, 2, 0.3)], fine=lambda t: [])
    assert S.xray_stage(raw["xray"], plan).filter("hrs_since_rapid_rise_xrsb_24h IS NULL").count() == 0
    out = S.forecast_latest(matrix, by, plan, rows=24).toPandas()
    assert len(out) == 24 and out["p_cumulative"].between(0, 1).all()
    same(out["p_cumulative"], 1 - (1 - out["p_h1"]) * (1 - out["p_h2"]))
