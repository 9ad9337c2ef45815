"""Parse jobs on literal text, feeds, scans, sinks and functions."""

from datetime import date, datetime

import pytest
from helpers import collect
from pyspark.sql import functions as F

from stormline.functions import lookup as L
from stormline.functions import times as T
from stormline.sources import feeds, text


def lines(spark, body, file="f"):
    return spark.createDataFrame([(file, i, line) for i, line in enumerate(body.split("\n"))], "file string, seq long, line string")


def test_pipe_catalogue_from_files(spark, tmp_path):
    body = "intro | x\n# CME | t0 | pa | halo?\n# note\n\n0001 | 2024/01/02 03:04 | 90 | II\n2|2024/01/02 05:00|bad\n# Flow\n3|2024/01/02 06:00|1|I"
    (tmp_path / "a.txt").write_text(body)
    parsed = text.parse_pipe_catalogue(text.read_lines(spark, str(tmp_path)))
    rows = [r["cells"] for r in parsed.orderBy("seq").collect()]
    assert rows == [
        {"CME": "0001", "t0": "2024/01/02 03:04", "pa": "90", "halo?": "II"}, {"CME": "2", "t0": "2024/01/02 05:00", "pa": "bad", "halo?": ""},
    ]
    out = text.normalize_catalogue(parsed, F.lit("2024-01-01"), "2024-01-01", "2024-01-02").orderBy("time_tag").collect()
    assert [r["event_id"] for r in out] == ["202401020304-0001", "202401020500-0002"]
    assert [r["position_angle"] for r in out] == [90.0, None] and [r["halo_class"] for r in out] == ["II", None]


def test_lines_without_heading_give_nothing(spark):
    assert text.parse_pipe_catalogue(lines(spark, "1 | 2\n# Flow")).count() == 0


def test_hourly_matrix_splits_glued_negatives(spark):
    body = "DST2401*02RRX020 000 11 -12-105 9999 x7 8\nother line\nDST no star"
    out = collect(text.parse_hourly_matrix(lines(spark, body), F.lit("2024-01-01")), "time_tag")
    assert list(zip(out["time_tag"].dt.hour, out["dst"])) == [(0, 11.0), (1, -12.0), (2, -105.0), (5, 8.0)]
    assert set(out["time_tag"].dt.day) == {2}


def test_pre_block(spark):
    body = "1 2 3\n<pre class='x'>\nDay list\n 5 -1 2\n40 1 2\n</pre>\n6 7 8"
    out = collect(text.parse_pre_block(lines(spark, body), F.lit("2024-02-01")), "time_tag")
    assert len(out) == 24 and set(out["time_tag"].dt.day) == {5}
    assert out["dst"].tolist()[:2] == [-1.0, 2.0] and out["dst"].isna().sum() == 22


def test_flux_layouts(spark):
    body = "fluxdate fluxtime\n20240102 170000 1 2 10.5 11 9\nx y 2024 01 03 2000 70 71 bad\n1 2 3"
    out = collect(text.parse_flux_table(lines(spark, body)), "time_tag")
    assert list(out["time_tag"]) == [datetime(2024, 1, 2, 17), datetime(2024, 1, 3, 20)]
    assert out["observed_flux"].tolist() == [10.5, 70.0] and out["ursi_flux"].isna().tolist() == [False, True]


def test_json_forms(spark):
    docs = [
        '[["TIME_TAG","Dst"],["2024-01-01 00:00:00","-5"],["x","1"]]', '[{"Time":"2024-01-01 01:00:00","dst":7},{"dst":1}]',
        '{"datetime":["2024-01-01 02:00:00","2024-01-01 03:00:00"],"DST":[1.5,null]}', "broken",
    ]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    out = collect(text.parse_json_series(df, "doc", ["time_tag", "time", "datetime"], ["dst"]), "time_tag")
    assert out["time_tag"].dt.hour.tolist() == [0, 1, 2, 3]
    assert out["dst"].tolist()[:3] == [-5.0, 7.0, 1.5] and out["dst"].isna().iloc[3]


def test_feed_shape_and_conflicts(spark):
    feed = feeds.FEEDS["plasma_b"]
    raw = spark.createDataFrame([("2024-01-01 00:00:00", float("nan"), 400.0), (None, 1.0, 2.0)], "time_tag string, density double, speed double")
    rows = feed.shape(raw).collect()
    assert len(rows) == 1 and rows[0]["density"] is None and rows[0]["temperature"] is None and rows[0]["speed"] == 400.0
    old, new = feed.shape(raw), feed.shape(raw.withColumn("speed", F.lit(1.0)))
    assert feed.upsert(old, new).collect()[0]["speed"] == 400.0
    replace = feeds.FEEDS["imf_a"].upsert(old.select("time_tag", "speed"), new.select("time_tag", "speed"))
    assert replace.collect()[0]["speed"] == 1.0


def test_stage_tables(spark, tmp_path):
    path = str(tmp_path / "stage")
    df = spark.createDataFrame([("train", 1), ("test", 2)], "split string, v long")
    assert feeds.read_stage(spark, path, df.schema).count() == 0
    feeds.write_stage(df, path)
    feeds.write_tail(df.filter("split = 'test'").withColumn("v", F.lit(9).cast("long")), path, ["split"])
    assert {tuple(r) for r in spark.read.parquet(path).select("split", "v").collect()} == {("train", 1), ("test", 9)}


def test_time_column_detection(spark):
    df = spark.createDataFrame([(1, 2)], "timestamp int, v int")
    assert feeds.detect_time(df).columns == ["ts", "v"]
    with pytest.raises(ValueError):
        feeds.detect_time(df.select("v"))


def test_scalar_functions(spark):
    df = spark.createDataFrame([(2.34, "m2.5", "x_d20240102_"), (0.165, "X", "ab700101"), (None, "q1", "2024_02_30")], "kp double, c string, f string")
    got = df.select(L.kp_to_ap(F.col("kp")), L.class_to_flux(F.col("c")), T.filename_date(F.col("f"), ["ab"]), L.bucket_right_closed(F.col("kp"), (2, 4, 6))).collect()
    assert [r[0] for r in got] == [9.0, 0.0, None]
    assert got[0][1] == pytest.approx(2.5e-5) and got[1][1] == 0.0 and got[2][1] is None
    assert [r[2] for r in got] == [date(2024, 1, 2), date(1970, 1, 1), None]
    assert [r[3] for r in got] == [1, 0, None]


def test_epoch_units(spark):
    df = spark.createDataFrame([("1704067200", "1704067200000", "2024-01-01 00:00:00"), ("x", None, "bad")], "s string, ms string, t string")
    rows = T.coerce_epoch(df, {"s": "a", "ms": "b", "t": "c"}).collect()
    assert [rows[0][c] for c in "abc"] == [datetime(2024, 1, 1)] * 3 and [rows[1][c] for c in "abc"] == [None] * 3


def test_pending_windows(spark):
    marks = spark.createDataFrame([("a", date(2024, 1, 1)), ("b", date(2024, 2, 10))], "source string, mark date")
    out = feeds.pending_windows(marks, "source", "mark", "2024-02-10", 30).orderBy("start").collect()
    assert [tuple(r) for r in out] == [("a", date(2024, 1, 2), date(2024, 1, 31)), ("a", date(2024, 2, 1), date(2024, 2, 10))]
