"""Runs, crossings, peaks and ranges against plain loops, whatever the chunk width."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import START, collect, random_series, to_spark
from pyspark.sql import functions as F

from stormline.operators import segments as S

CHUNKS = ["9h", "400d"]


def coarse(seed, irregular=False, step=40):
    pdf = random_series(seed, n=120, irregular=irregular, missing=0)
    pdf["v"] = np.floor(pdf["v"] / step) * step
    return pdf.sort_values(["k", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("irregular", [False, True])
def test_run_segments(spark, chunk, irregular):
    pdf = coarse(1, irregular)
    out = collect(S.run_segments(to_spark(spark, pdf), F.col("v"), keys=["k"], ts="ts", chunk=chunk, neighbours=True), "k", "ts")
    for k, g in pdf.groupby("k"):
        got = out[out.k == k].reset_index(drop=True)
        g = g.reset_index(drop=True)
        seg = (g["v"] != g["v"].shift()).cumsum()
        assert list(got["seg"]) == list(seg)
        assert list(got["seg_len"]) == list(seg.map(seg.value_counts()))
        assert list(got["seg_start"]) == list(g["ts"].groupby(seg).transform("min"))
        values = g["v"].groupby(seg).first()
        assert got["state_before"].fillna(-9e9).tolist() == seg.map(values.shift()).fillna(-9e9).tolist()
        assert got["state_after"].fillna(-9e9).tolist() == seg.map(values.shift(-1)).fillna(-9e9).tolist()


@pytest.mark.parametrize("chunk", CHUNKS)
def test_run_segments_keep_null_states_apart(spark, chunk):
    pdf = random_series(2, n=90)
    out = collect(S.run_segments(to_spark(spark, pdf), F.col("v").isNull(), keys=["k"], ts="ts", chunk=chunk), "k", "ts")
    gone = pdf.sort_values(["k", "ts"]).reset_index(drop=True)
    turn = (gone["v"].isna() != gone.groupby("k")["v"].shift().isna()) | (gone.groupby("k").cumcount() == 0)
    assert list(out["seg"]) == list(turn.groupby(gone["k"]).cumsum())


@pytest.mark.parametrize("chunk", CHUNKS)
def test_drop_long_missing(spark, chunk):
    pdf = random_series(3, n=100, missing=0.6)
    out = collect(S.drop_long_missing(to_spark(spark, pdf), ["v"], 2, keys=["k"], ts="ts", chunk=chunk), "k", "ts")
    gone = pdf["v"].isna()
    runs = ((gone != gone.shift()) | (pdf["k"] != pdf["k"].shift())).cumsum()
    kept = pdf[~(gone & (gone.groupby(runs).transform("sum") > 2))].sort_values(["k", "ts"])
    assert list(out["ts"]) == list(kept["ts"])


@pytest.mark.parametrize("chunk", CHUNKS)
def test_flag_intervals_and_crossings(spark, chunk):
    pdf = random_series(4, n=100, missing=0, irregular=True)
    df = to_spark(spark, pdf)
    got = collect(S.flag_intervals(df, F.col("v") > 20, keys=["k"], ts="ts", chunk=chunk), "k", "start")
    want, falls = [], []
    for k, g in pdf.sort_values("ts").groupby("k"):
        on, times = (g["v"] > 20).to_numpy(), list(g["ts"])
        v = g["v"].to_numpy()
        opened = None
        for i, flag in enumerate(on):
            if flag and opened is None:
                opened = times[i]
            if not flag and opened is not None:
                want.append((k, opened, times[i]))
                opened = None
            if i and v[i] <= 0 < v[i - 1]:
                falls.append((k, times[i]))
        if opened is not None:
            want.append((k, opened, times[-1]))
    assert [tuple(r) for r in got.itertuples(index=False)] == want
    crossed = collect(S.crossings(df, "v", 0.0, keys=["k"], ts="ts", chunk=chunk), "k", "ts")
    assert list(zip(crossed["k"], crossed["ts"])) == falls


def find_peaks(v):
    out, i = [], 1
    while i < len(v) - 1:
        if v[i - 1] < v[i]:
            j = i
            while j < len(v) - 1 and v[j + 1] == v[i]:
                j += 1
            if j < len(v) - 1 and v[j + 1] < v[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return out


def prominence(v, p):
    left, i = v[p], p
    while i >= 0 and v[i] <= v[p]:
        left, i = min(left, v[i]), i - 1
    right, i = v[p], p
    while i < len(v) and v[i] <= v[p]:
        right, i = min(right, v[i]), i + 1
    return v[p] - max(left, right)


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("seed", [5, 6])
def test_peaks(spark, chunk, seed):
    pdf = coarse(seed, irregular=True, step=15)
    df = to_spark(spark, pdf)
    plain = collect(S.local_peaks(df, "v", keys=["k"], ts="ts", chunk=chunk), "k", "ts")
    high = collect(S.local_peaks(df, "v", keys=["k"], ts="ts", height=30.0, chunk=chunk), "k", "ts")
    strong = collect(S.prominent_peaks(df, "v", keys=["k"], ts="ts", prominence=60.0, chunk=chunk), "k", "ts")
    found = {"plain": [], "high": [], "strong": []}
    for k, g in pdf.groupby("k"):
        v, ts = g["v"].to_numpy(), list(g["ts"])
        for p in find_peaks(v):
            found["plain"].append((k, ts[p]))
            if v[p] >= 30:
                found["high"].append((k, ts[p]))
            if prominence(v, p) >= 60:
                found["strong"].append((k, ts[p]))
    for name, out in (("plain", plain), ("high", high), ("strong", strong)):
        assert list(zip(out["k"], out["ts"])) == found[name]


def test_gap_hours(spark):
    pdf = pd.DataFrame({"k": "a", "ts": START + pd.to_timedelta([0, 1, 2, 5, 30], unit="h"), "v": [1.0, np.nan, 2.0, 3.0, 4.0]})
    out = collect(S.gap_hours(to_spark(spark, pdf), "v", keys=["k"], ts="ts", chunk="2h"), "ts")
    assert list(out["gap_hours"]) == [0.0, 2.0, 3.0, 25.0]


@pytest.mark.parametrize("chunk_days", [3, 10, 3650])
def test_missing_ranges(spark, chunk_days):
    rng = np.random.default_rng(9)
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(60)]
    present = {k: sorted(d for d in days if rng.random() < 0.4) for k in ("a", "b")}
    expected = spark.createDataFrame([(k, d) for k in present for d in days], "k string, d date")
    have = spark.createDataFrame([(k, d) for k, ds in present.items() for d in ds], "k string, d date")
    got = collect(S.missing_ranges(expected, have, "d", keys=["k"], chunk_days=chunk_days), "k", "start")
    want = []
    for k, ds in present.items():
        run = None
        for d in [*days, None]:
            if d is not None and d not in ds:
                run = (run[0], d) if run else (d, d)
            elif run:
                want.append((k, *run))
                run = None
    assert [tuple(r) for r in got.itertuples(index=False)] == want
