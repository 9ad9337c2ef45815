"""Fills, interpolation, as-of joins and gap rules against pandas."""

import numpy as np
import pandas as pd
import pytest
from helpers import START, collect, random_series, same, to_spark
from pyspark.sql import functions as F

from stormline.operators import quality as Q
from stormline.operators.fill import asof_join, bfill, exact_then_ffill, ffill, interpolate_both
from stormline.operators.resample import grouped_median, resample_last, resample_mean

CHUNKS = ["5h", "400d"]


def per_key(pdf, fn):
    return np.concatenate([fn(g.set_index("ts")["v"]).to_numpy() for _, g in pdf.sort_values(["k", "ts"]).groupby("k")])


@pytest.mark.parametrize("chunk", CHUNKS)
def test_fills(spark, chunk):
    pdf = random_series(1, missing=0.8, irregular=True)
    df = to_spark(spark, pdf)
    same(collect(ffill(df, ["v"], keys=["k"], ts="ts", chunk=chunk), "k", "ts")["v"], per_key(pdf, lambda s: s.ffill()))
    same(collect(bfill(df, ["v"], keys=["k"], ts="ts", chunk=chunk), "k", "ts")["v"], per_key(pdf, lambda s: s.bfill()))


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("irregular", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_interpolation_from_both_sides(spark, chunk, irregular, seed):
    pdf = random_series(seed, n=150, missing=0.7, irregular=irregular)
    df, where = to_spark(spark, pdf), {"keys": ["k"], "ts": "ts", "chunk": chunk, "step": None if irregular else "1h"}
    bounded = lambda s: s.interpolate(method="time", limit=3, limit_direction="both")
    same(collect(interpolate_both(df, "v", limit=3, **where), "k", "ts")["v"], per_key(pdf, bounded))
    closed = collect(interpolate_both(df, "v", limit=3, close=True, **where), "k", "ts")["v"]
    same(closed, per_key(pdf, lambda s: bounded(s).ffill().bfill().fillna(0.0)))


def gap_rule(s: pd.Series) -> pd.Series:
    out, gone = s.interpolate(method="time", limit=3, limit_direction="both"), s.isna()
    runs = (gone != gone.shift()).cumsum()
    length = gone.groupby(runs).transform("sum")
    return out.where(~(gone & (length > 3)), 0.0).fillna(0.0)


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("irregular", [False, True])
def test_gap_rule(spark, chunk, irregular):
    pdf = random_series(4, n=150, missing=0.6, irregular=irregular)
    out = collect(
        Q.impute_gap_rule(to_spark(spark, pdf), ["v"], keys=["k"], ts="ts", chunk=chunk, step=None if irregular else "1h"), "k", "ts"
    )
    same(out["v"], per_key(pdf, gap_rule))
    ordered = pdf.sort_values(["k", "ts"]).reset_index(drop=True)
    assert set(out["v_missing_flag"][ordered["v"].notna()]) == {0}
    assert (out["v"][out["v_missing_flag"] == 1] == 0.0).all()


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("chunk", CHUNKS)
def test_asof_join(spark, chunk, strict):
    left = random_series(5, missing=0).rename(columns={"v": "x"})
    right = random_series(6, n=60, irregular=True, missing=0.5)
    right.loc[::4, "ts"] = right.loc[::4, "ts"].dt.floor("h")
    right = right.drop_duplicates(["k", "ts"])
    got = collect(asof_join(to_spark(spark, left), to_spark(spark, right), keys=["k"], ts="ts", cols=["v"], chunk=chunk, strict=strict), "k", "ts")
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="k", allow_exact_matches=not strict)
    same(got["v"], want.sort_values(["k", "ts"])["v"])


def test_exact_then_ffill_misses_events_off_the_grid(spark):
    grid = pd.DataFrame({"k": "a", "ts": START + pd.to_timedelta(range(6), unit="h")})
    events = pd.DataFrame({"k": "a", "ts": START + pd.to_timedelta([60, 150, 240], unit="m"), "m": [1.0, 2.0, 3.0]})
    out = collect(exact_then_ffill(to_spark(spark, grid), to_spark(spark, events), {"m": 0.0}, keys=["k"], ts="ts"), "ts")
    assert list(out["m"]) == [0.0, 1.0, 1.0, 1.0, 3.0, 3.0]


def test_resample(spark):
    pdf = random_series(7, n=80, irregular=True)
    df = to_spark(spark, pdf)
    mean = collect(resample_mean(df, ["v"], keys=["k"], ts="ts"), "k", "ts")["v"]
    same(mean, per_key(pdf, lambda s: s.resample("1h").mean()))
    last = collect(resample_last(df, ["v"], keys=["k"], ts="ts", chunk="1d"), "k", "ts")["v"]

    def held(s):  # the last row at or before each bin start, a missing value included
        bins = s.resample("1h").mean().index
        at = s.index.searchsorted(bins, side="right") - 1
        return pd.Series([s.iloc[i] if i >= 0 else np.nan for i in at])

    same(last, per_key(pdf, held))


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_grouped_median(spark, bins):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 501, p=[0.9, 0.07, 0.03]), "v": np.round(rng.normal(0, 3, 501), 1)})
    out = collect(grouped_median(to_spark(spark, pdf), "v", keys=["k"], bins=bins), "k")
    same(out["v"], pdf.groupby("k")["v"].median())


def test_row_repairs(spark):
    df = spark.createDataFrame([(1, 4.0, None, 9.0), (2, None, None, None), (3, -1.0, 1e-10, 2.0)], "i int, a double, b double, c double")
    got = df.select("i", Q.row_median(["a", "b", "c"]).alias("m"), Q.all_missing_flag(["a", "b", "c"]).alias("f"), Q.floor_clip(F.col("a")).alias("p"))
    assert [tuple(r) for r in got.orderBy("i").collect()] == [(1, 6.5, 0, 4.0), (2, None, 1, None), (3, 1e-10, 0, 0.0)]


def test_required_and_splits(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1.0), ("2024-01-02 23:00:00", None)], "t string, v double").selectExpr("CAST(t AS TIMESTAMP) ts", "v")
    with pytest.raises(Exception, match="missing value in v"):
        Q.require_complete(df, ["v"]).collect()
    windows = {"train": ("2024-01-01", "2024-01-02"), "test": ("2024-01-03", "2024-01-04")}
    split = Q.temporal_split(df, "ts", windows)
    assert split.count() == 1  # an end given as a day stops at its midnight
    with pytest.raises(ValueError, match="test"):
        Q.require_splits(split, windows)
    assert Q.temporal_split(df, "ts", windows, skip=True).count() == 4
