"""Spikes, constant columns, stray tags, skewed values, several series: results that must not depend on the data's shape."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from helpers import START, collect, same, to_spark
from pyspark.sql import functions as F

from stormline.operators import resample
from stormline.operators import rolling as R
from stormline.operators.chunks import CHUNK, with_value_bin
from stormline.operators.sets import latest_n, preferred
from stormline.plans import collinearity as C
from stormline.plans import metrics as P
from stormline.session import shared_folder
from stormline.sources import text


@pytest.mark.parametrize("chunk", ["2d", "10d", "30d"])
def test_a_spike_leaves_no_trace_in_later_windows(spark, chunk):
    rng = np.random.default_rng(4)
    v = np.round(0.1 * rng.normal(size=1500), 6)
    v[5] = 1e6
    v[rng.random(1500) < 0.1] = np.nan
    pdf = pd.DataFrame({"ts": START + pd.to_timedelta(np.arange(1500), unit="h"), "v": v})
    out = R.rolling(
        to_spark(spark, pdf),
        {
            "s": R.wide_std_samp("v", span="12h", min_periods=3), "p": R.wide_std_pop("v", rows=12, min_periods=3), "m": R.wide_mean("v", span="12h", min_periods=3),
            "f": R.wide_fraction(F.col("v") > 0, span="100h", min_periods=1),
        },
        keys=[], ts="ts", chunk=chunk, step="1h",
    )
    got, s = collect(out, "ts"), pdf.set_index("ts")["v"]
    exact = lambda f: np.array([f(w) if len(w := s.iloc[max(0, i - 11) : i + 1].dropna()) >= 3 else np.nan for i in range(1500)])
    same(got["s"], exact(lambda w: w.std()), 1e-9)
    same(got["p"], exact(lambda w: w.std(ddof=0)), 1e-9)
    same(got["m"], exact(lambda w: w.mean()), 1e-9)
    same(got["f"], [(s.iloc[max(0, i - 99) : i + 1] > 0).mean() for i in range(1500)], 1e-9)


def test_wide_windows_over_irregular_and_equal_times(spark):
    rng = np.random.default_rng(5)
    minutes = np.sort(rng.integers(0, 3000, 800))
    pdf = pd.DataFrame({"ts": START + pd.to_timedelta(minutes, unit="m"), "v": rng.normal(size=800)})
    got = collect(R.rolling(to_spark(spark, pdf), {"s": R.wide_std_samp("v", span="45m")}, keys=[], ts="ts", chunk="6h"), "ts")
    want = [pdf["v"][(minutes > t - 45) & (minutes <= t)].std() for t in minutes]
    same(got["s"], want, 1e-9)


def test_constant_and_nearly_equal_columns(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=400)
    df = to_spark(spark, pd.DataFrame({"a": a, "near": a + 1e-6 * rng.normal(size=400), "b": rng.normal(size=400), "c": 3.0}))
    row = C.condition_number(df, ["a", "b", "c"]).head()
    assert row["condition_number"] == float("inf") and row["near_degenerate"] == 1
    got = {r["feature"]: r["vif"] for r in C.vif(df, ["a", "near", "b", "c"]).collect()}
    assert got["c"] is None and 1e11 < got["a"] < 1e13 and got["b"] < 2
    twice = {r["feature"]: r["vif"] for r in C.vif(df.withColumn("again", F.col("a") * 3 + 1), ["a", "again", "b", "c"]).collect()}
    assert twice["a"] == twice["again"] == float("inf") and twice["b"] < 2
    assert C.vif(df.filter("false"), ["a", "b"]).filter("vif IS NULL").count() == 2


def test_stray_closing_tags(spark):
    day = " 1 " + " ".join(str(i) for i in range(24))
    lines = [("f", i, x) for i, x in enumerate(["</pre>", "<p>text</pre>", "<pre>", day, "</pre>", day])] + [("g", i, x) for i, x in enumerate(["<pre></pre>", day])]
    df = spark.createDataFrame(lines, "file string, seq long, line string")
    got = text.parse_pre_block(df, F.lit("2024-01-01"), keep=("file",)).groupBy("file").count().collect()
    assert {r["file"]: r["count"] for r in got} == {"f": 24, "g": 24}


def test_a_large_file_is_read_in_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(5000)))
    (tmp_path / "b.txt").write_text("only\r\nthese\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = text.read_lines(spark, str(tmp_path))
        got = {(r["file"][-5:], r["seq"]): r["line"] for r in rows.collect()}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {**{("a.txt", i): f"line {i}" for i in range(5000)}, ("b.txt", 0): "only", ("b.txt", 1): "these"}


def test_bins_hold_equal_shares_of_skewed_values(spark):
    rng = np.random.default_rng(7)
    scores, wide = rng.beta(0.3, 300, 20_000), 10 ** rng.uniform(-9, -3, 20_000)
    for values in (scores, np.r_[wide, 1e9]):
        df = to_spark(spark, pd.DataFrame({"v": values}))
        sizes = [r["count"] for r in with_value_bin(df, "v", 64).groupBy(CHUNK).count().collect()]
        assert max(sizes) <= 2 * len(values) / 64
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 20_000), "v": wide})
    got = collect(resample.grouped_median(to_spark(spark, pdf), "v", keys=["k"]), "k")
    same(got["v"], pdf.groupby("k")["v"].median(), 1e-12)
    curve = P.pr_curve(to_spark(spark, pd.DataFrame({"p": scores, "y": (rng.random(20_000) < scores * 50).astype(int)})), "y", "p")
    assert curve.count() == len(set(scores)) and curve.filter("recall > 1 OR precision > 1").count() == 0


def test_newest_rows_of_each_series_from_one_split(spark):
    pdf = pd.DataFrame([(s, k, START + pd.Timedelta(hours=h)) for s in ("train", "validation", "test") for k in "ab" for h in range(50)], columns=["split", "k", "ts"])
    df = to_spark(spark, pdf)
    got = latest_n(preferred(df, "split", ["test", "validation", "train"]), 20, ["ts"], ["k"])
    assert {tuple(r) for r in got.groupBy("split", "k").agg(F.count("ts"), F.min(F.hour("ts") + 24 * (F.dayofmonth("ts") - 1))).collect()} == {("test", "a", 20, 30), ("test", "b", 20, 30)}
    assert preferred(df.filter("split <> 'test'"), "split", ["test", "validation"]).select("split").distinct().collect()[0][0] == "validation"
    assert preferred(df, "split", ["other"]).select("split").distinct().collect()[0][0] == "test"


def test_names_with_spaces(spark):
    from stormline.operators.fill import interpolate_both
    from stormline.operators.quality import impute_gap_rule

    pdf = pd.DataFrame({"time tag": START + pd.to_timedelta(range(6), unit="h"), "v": [1.0, np.nan, 3.0, np.nan, np.nan, 6.0]})
    df = to_spark(spark, pdf)
    same(collect(interpolate_both(df, "v", keys=[], ts="time tag", limit=3, step="1h"), "time tag")["v"], [1, 2, 3, 4, 5, 6])
    same(collect(impute_gap_rule(df, ["v"], keys=[], ts="time tag", step="1h"), "time tag")["v"], [1, 2, 3, 4, 5, 6])


def test_segments_and_dispatch(spark):
    from stormline.sources import feeds

    assert feeds.segments("2024-01-01", "2024-01-20", "2024-01-10") == [("archive", "2024-01-01", "2024-01-09"), ("realtime", "2024-01-10", "2024-01-20")]
    assert feeds.segments("2023-12-01", "2024-01-05", "2024-01-10", ("2024-01-01", "2024-01-03")) == [("archive", "2024-01-01", "2024-01-03")]
    assert feeds.segments("2020-01-01", "2020-02-01", "2024-01-10", ("2021-01-01", None)) == [("realtime", "2020-01-01", "2020-02-01")]
    rows = [(datetime(2024, 1, 5), "a", "f1", 1.0), (datetime(2024, 1, 12), "a", "f2", 2.0), (datetime(2024, 1, 12), "b", "f2", 3.0)]
    df = spark.createDataFrame(rows, "event_time timestamp, satellite string, flare_id string, xrsb_flux double")
    routed = feeds.route_segments(df.filter("satellite = 'a'"), df, "event_time", start="2024-01-01", end="2024-01-31", realtime_from="2024-01-10", archive_days=("2024-01-02", None))
    kinds = {"archive": feeds.FEEDS["flares_archive"], "realtime": feeds.FEEDS["flares_realtime"]}
    stored = {n: spark.createDataFrame([], k.schema) for n, k in kinds.items()}
    out = feeds.dispatch(routed, stored, kinds, ["satellite"])
    assert [r["flare_id"] for r in out["archive"].collect()] == ["f1"] and [(r["flare_id"], r["satellite"]) for r in out["realtime"].collect()] == [("f2", "b")]


def test_high_water_marks_over_unnamed_times(spark):
    from stormline.sources import feeds

    df = spark.createDataFrame([("a", "2024-01-01", "x", 5), ("a", "2024-02-01", "2024-03-01", 6), ("b", None, "no", 7)], "source string, Obs_Date string, timeTag string, v int")
    got = {r["source"]: r["latest_timestamp"] for r in feeds.high_water_mark(df, "source").collect()}
    assert got == {"a": pd.Timestamp("2024-03-01"), "b": None}
    assert feeds.high_water_mark(df, "source", ["Obs_Date", "absent"]).filter("source = 'a'").head()[1] == pd.Timestamp("2024-02-01")


def test_split_bounds(spark):
    from stormline.operators import quality as Q

    df = spark.createDataFrame([("train", "2024-01-01 00:30:00"), ("train", "2024-01-02 01:00:00"), ("test", "2024-02-01 05:10:00")], "split string, t string").selectExpr("split", "CAST(t AS TIMESTAMP) AS ts")
    assert Q.split_bounds(df, "ts", ("train", "test")) == {"train": ("2024-01-01 00:00:00", "2024-01-02 01:00:00"), "test": ("2024-02-01 05:00:00", "2024-02-01 06:00:00")}
    with pytest.raises(ValueError, match="validation"):
        Q.split_bounds(df, "ts")


def test_intermediates_go_to_the_shared_folder(spark):
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
