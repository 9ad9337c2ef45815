"""Onsets, spacing, labels and interval merging against plain loops."""

import numpy as np
import pandas as pd
import pytest
from helpers import START, collect, to_spark
from pyspark.sql import functions as F

from stormline.operators import events as E

CHUNKS = ["5h", "400d"]


def times(seed, n=80, hours=400):
    rng = np.random.default_rng(seed)
    at = START + pd.to_timedelta(np.sort(rng.integers(0, hours * 60, n)), unit="m")
    return pd.DataFrame({"k": rng.choice(["a", "b"], n, p=[0.8, 0.2]), "ts": at}).drop_duplicates()


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_spacing(spark, chunk, seed):
    pdf = times(seed, n=150)
    got = collect(E.greedy_spacing(to_spark(spark, pdf), keys=["k"], ts="ts", gap="4h", chunk=chunk), "k", "ts")
    want = []
    for k, g in pdf.groupby("k"):
        last = None
        for t in sorted(g["ts"]):
            if last is None or t - last >= pd.Timedelta(hours=4):
                want.append((k, t))
                last = t
    assert list(zip(got["k"], got["ts"])) == want


def test_greedy_spacing_without_keys(spark):
    pdf = times(3).drop(columns="k").drop_duplicates()
    got = collect(E.greedy_spacing(to_spark(spark, pdf), keys=[], ts="ts", gap="6h", chunk="1d"), "ts")
    gaps = got["ts"].diff().dropna()
    assert (gaps >= pd.Timedelta(hours=6)).all() and got["ts"].iloc[0] == pdf["ts"].min()


@pytest.mark.parametrize("shift", [0, 25])
def test_hazard_labels(spark, shift):
    onsets = times(4, n=15, hours=100).rename(columns={"ts": "o"})
    index = pd.DataFrame([(k, START + pd.Timedelta(hours=h, minutes=shift)) for k in ("a", "b") for h in range(110)], columns=["k", "ts"])
    got = collect(E.hazard_labels(to_spark(spark, index), to_spark(spark, onsets), keys=["k"], ts="ts", onset="o"), "k", "ts")
    for row in got.itertuples():
        mine = onsets["o"][onsets["k"] == row.k]
        hours = [(o - row.ts) / pd.Timedelta(hours=1) for o in mine]
        for h in range(1, 9):
            assert getattr(row, f"h_{h}") == int(any(h - 1 < x <= h for x in hours))
    counted = collect(E.count_onsets(to_spark(spark, got), keys=["k"], ts="ts"), "k")
    pointed = {k: set() for k in ("a", "b")}
    for row in got.itertuples():
        pointed[row.k] |= {row.ts + pd.Timedelta(hours=h) for h in range(1, 9) if getattr(row, f"h_{h}")}
    assert list(counted["n_onsets"]) == [len(pointed["a"]), len(pointed["b"])]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_merge_intervals(spark, chunk):
    pdf = times(5, n=60).rename(columns={"ts": "s"})
    pdf["e"] = pdf["s"] + pd.to_timedelta(np.random.default_rng(6).integers(0, 20, len(pdf)), unit="h")
    got = collect(E.merge_intervals(to_spark(spark, pdf), keys=["k"], start="s", end="e", chunk=chunk), "k", "s")
    want = []
    for k, g in pdf.groupby("k"):
        merged = []
        for s, e in sorted(zip(g["s"], g["e"])):
            if merged and s <= merged[-1][1] + pd.Timedelta(hours=1):
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want += [(k, *m) for m in merged]
    assert [tuple(r) for r in got.itertuples(index=False)] == want


@pytest.mark.parametrize("chunk", CHUNKS)
def test_storms(spark, chunk):
    rng = np.random.default_rng(7)
    n = 300
    pdf = pd.DataFrame({"k": "a", "ts": START + pd.to_timedelta(range(n), unit="h"), "dst": np.round(rng.normal(-20, 60, n)), "ap": rng.choice([10.0, 50.0], n)})
    storm = (F.col("ap") > 39) & (F.col("dst") < -50)
    df = to_spark(spark, pdf)
    onsets = collect(E.storm_onsets(df, "dst", storm, keys=["k"], ts="ts", chunk=chunk), "onset")
    spans = collect(E.storm_intervals(df, "dst", storm, keys=["k"], ts="ts", chunk=chunk), "start")
    mask, falls = ((pdf["ap"] > 39) & (pdf["dst"] < -50)), pdf["ts"][(pdf["dst"] <= 0) & (pdf["dst"].shift() > 0)]
    want, intervals = [], []
    for _, seg in pdf[mask].groupby((mask != mask.shift()).cumsum()[mask]):
        prior = falls[falls <= seg["ts"].iloc[0]]
        if len(prior):
            want.append(prior.iloc[-1])
        intervals.append([prior.iloc[-1] if len(prior) else seg["ts"].iloc[0], seg["ts"][seg["dst"].idxmin()]])
    assert list(onsets["onset"]) == want
    merged = []
    for s, e in sorted(intervals):
        if merged and s <= merged[-1][1] + pd.Timedelta(hours=1):
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    assert [[r.start, r.end] for r in spans.itertuples()] == merged
