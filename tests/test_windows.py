"""Trailing windows against pandas, whatever the chunk width."""

import numpy as np
import pandas as pd
import pytest
from helpers import collect, random_series, same, to_spark
from pyspark.sql import functions as F

from stormline.operators import rolling as R
from stormline.operators.chunks import balanced_chunk, positions

CHUNKS = ["7h", "400d"]


def by_key(pdf, fn):
    return np.concatenate([fn(g.set_index("ts")["v"]).to_numpy() for _, g in pdf.groupby("k", sort=True)])


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("irregular", [False, True])
def test_time_windows(spark, chunk, irregular):
    pdf = random_series(1, irregular=irregular)
    out = collect(
        R.rolling(
            to_spark(spark, pdf),
            {
                "mean": R.mean("v", span="6h", min_periods=3),
                "std": R.std_pop("v", span="12h"),
                "low": R.lowest("v", span="24h", min_periods=12),
                "high": R.highest("v", span="6h"),
                "sum": R.total("v", span="6h", min_periods=3),
                "wide": R.wide_mean("v", span="72h", min_periods=10),
                "wide_std": R.wide_std_samp("v", span="72h", min_periods=10),
            },
            keys=["k"], ts="ts", chunk=chunk,
        ),
        "k", "ts",
    )
    pdf = pdf.sort_values(["k", "ts"])
    same(out["mean"], by_key(pdf, lambda s: s.rolling("6h", min_periods=3).mean()))
    same(out["std"], by_key(pdf, lambda s: s.rolling("12h", min_periods=1).std(ddof=0)))
    same(out["low"], by_key(pdf, lambda s: s.rolling("24h", min_periods=12).min()))
    same(out["high"], by_key(pdf, lambda s: s.rolling("6h", min_periods=1).max()))
    same(out["sum"], by_key(pdf, lambda s: s.rolling("6h", min_periods=3).sum()))
    same(out["wide"], by_key(pdf, lambda s: s.rolling("72h", min_periods=10).mean()), 1e-7)
    same(out["wide_std"], by_key(pdf, lambda s: s.rolling("72h", min_periods=10).std()), 1e-6)


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("regular", [True, False])
def test_row_windows(spark, chunk, regular):
    pdf = random_series(2, irregular=not regular)
    out = collect(
        R.rolling(
            to_spark(spark, pdf),
            {
                "sum": R.total("v", rows=24), "mean": R.wide_mean("v", rows=50, min_periods=24),
                "lag": R.shifted("v", rows=6), "centred": R.centred_mean("v", rows=11),
            },
            keys=["k"], ts="ts", chunk=chunk, step="1h" if regular else None, chunk_rows=40,
        ),
        "k", "ts",
    )
    pdf = pdf.sort_values(["k", "ts"])
    same(out["sum"], by_key(pdf, lambda s: s.rolling(24, min_periods=1).sum()))
    same(out["mean"], by_key(pdf, lambda s: s.rolling(50, min_periods=24).mean()), 1e-7)
    same(out["lag"], by_key(pdf, lambda s: s.shift(6)))
    same(out["centred"], by_key(pdf, lambda s: s.rolling(11, center=True, min_periods=1).mean()))


def slope(window):
    y = window.to_numpy(float)
    ok = np.isfinite(y)
    return np.polyfit(np.arange(len(y))[ok], y[ok], 1)[0] if ok.sum() > 1 else np.nan


@pytest.mark.parametrize("chunk", CHUNKS)
def test_slopes_fractions_and_recency(spark, chunk):
    pdf = random_series(3)
    big = F.col("v") > 40
    out = collect(
        R.rolling(
            to_spark(spark, pdf),
            {
                "slope": R.slope("v", span="6h", min_periods=3), "strict": R.slope("v", span="6h", min_periods=3, strict=True),
                "frac": R.fraction(F.col("v") < 0, span="6h", min_periods=3), "since": R.since_true(big, span="24h"),
            },
            keys=["k"], ts="ts", chunk=chunk,
        ),
        "k", "ts",
    )
    same(out["slope"], by_key(pdf, lambda s: s.rolling("6h", min_periods=3).apply(slope, raw=False)), 1e-6)
    strict = by_key(pdf, lambda s: s.rolling("6h", min_periods=3).apply(lambda w: np.nan if w.isna().any() else slope(w), raw=False))
    same(out["strict"], strict, 1e-6)
    same(out["frac"], by_key(pdf, lambda s: (s < 0).rolling("6h", min_periods=3).mean()))
    recent = by_key(pdf, lambda s: (s > 40).astype(int).rolling("24h", min_periods=1).apply(lambda w: np.argmax(w[::-1]) if w.any() else np.nan, raw=True))
    same(out["since"], recent)


def test_half_open_window_holds_six_rows(spark):
    pdf = random_series(4, n=12, keys=("a",), missing=0)
    out = collect(R.rolling(to_spark(spark, pdf).withColumn("one", F.lit(1)), {"n": R.total("one", span="6h")}, keys=["k"], ts="ts"), "ts")
    assert out["n"].max() == 6


def test_windows_restart_at_split_borders(spark):
    pdf = random_series(5, n=48, keys=("a",), missing=0)
    pdf["split"] = np.where(pdf["ts"] < pd.Timestamp("2024-01-02"), "train", "test")
    out = collect(R.rolling(to_spark(spark, pdf), {"m": R.mean("v", span="6h", min_periods=3)}, keys=["k", "split"], ts="ts", chunk="10h"), "ts")
    assert list(out.index[out["m"].isna()]) == [0, 1, 24, 25]


def test_slice_reads_only_what_windows_reach(spark):
    df = to_spark(spark, random_series(6))
    columns = {"m": R.mean("v", span="24h"), "p": R.shifted("v", rows=5)}
    full = R.rolling(df, columns, keys=["k"], ts="ts", chunk="30h", step="1h")
    part = R.rolling(df, columns, keys=["k"], ts="ts", chunk="30h", step="1h", between=("2024-01-04 05:00:00", "2024-01-05 00:00:00"))
    expected = collect(full.filter("ts >= '2024-01-04 05:00:00' AND ts <= '2024-01-05'"), "k", "ts")
    pd.testing.assert_frame_equal(collect(part, "k", "ts"), expected)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_positions(spark, chunk):
    pdf = random_series(7, irregular=True)
    out = collect(positions(to_spark(spark, pdf), keys=["k"], ts="ts", chunk=chunk), "k", "ts")
    assert list(out["_pos"]) == list(out.groupby("k").cumcount())


def test_balanced_chunk(spark):
    df = spark.range(0, 36_000).selectExpr("'hot' AS k", "timestamp_seconds(id DIV 10) AS ts")  # 36000 rows within an hour
    assert balanced_chunk(df, keys=["k"], ts="ts", rows=100_000) >= 3_600_000_000
    assert balanced_chunk(df, keys=["k"], ts="ts", rows=1_800) == 3 * 60_000_000
    assert balanced_chunk(df, keys=["k"], ts="ts", rows=5) == 1_000_000
