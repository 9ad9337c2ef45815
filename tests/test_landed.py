"""The `landed` data source against the native parsers, byte splits, pushed bounds and streams."""

import json
import os
import random
from datetime import datetime, timezone

import pytest
from pyarrow import fs

from stormline.sources import feeds, landed

UTC = timezone.utc
FILES = {
    "dst": {
        "202401/dst2401.for.request": "DST2401*02RRX020 000 11 -12-105 9999 x7 8\nother\nDST no star\nDST2401*31XX 0 1\r\nDST2401*32XX 0 5",
        "1996-02/index.html": "1 2 3\n<pre class='x'>\nDay list\n29 -1 2\n30 1 2\n 5 7 99999\n</pre>\n6 7 8\n<pre>\n7 1 1\n</pre>",
        "nomonth.txt": "DST*02RRX020 000 11",
    },
    "cme": {
        "cme_2024_01.txt": "intro | x\n# CME | t0 | pa | v | halo?\n# note\n\n0001 | 2024/01/02 03:04 | 90 | 1.5e2 | II\n2|2024/01/02 05:00|bad\n3|no time|1|2|I\n|2024/01/03 00:00|1|2| \n# Flow\n4|2024/01/02 06:00|1|1|I",
        "cme_2024_02.txt": "no heading | 2024/01/02 03:04",
    },
    "radio_flux": {"a.txt": "fluxdate fluxtime\n20240102 170000 1 2 10.5 11 9\nx y 2024 01 03 2000 70 71 bad\n1 2 3\nJulian 1 2 3 4 5 6\n\n20240231 170000 1 2 1 1 1", "b.txt": "20240104 90 1 2 1 2 3\n"},
    "kp_index": {
        "a.json": '{"datetime":["2024-01-01T02:00:00Z","2024-01-01T03:00:00+01:00", null],"Kp":[1.5,null,3]}', "b.json": "broken", "c.json": "",
        "d/e.json": '[["TIME_TAG","KP"],["2024-01-05 00:00:00","-5"],["x","1"]]', "f.json": '[{"Time":"2024-01-06 01:00:00","kp":7},{"kp":1}]',
    },
    "sunspot_number": {"a.json": '[{"time_tag":"2024-01-06","ssn":7},{"time_tag":"2024-01-07","sunspot_number":8}]'},
    "imf_b": {"a.json": '[{"time_tag":"2024-01-06 00:01:00","bt":7,"bx_gsm":"1.5","bz_gsm":"x"}]'},
    "flares_realtime": {
        "a.json": "\n".join(json.dumps(r) for r in [
            {"time": "2024-01-01 00:00:00", "flare_id": "a", "flare_class": "M2.5", "xrsb_flux": 3}, {"time": "2024-01-01 01:00:00", "flare_id": "b", "flare_class": "c", "satellite": "s"},
            {"time": "2024-01-01 02:00:00", "flare_id": "c", "flare_class": "Q1", "xrsb_flux": "0.5"}, {"time": "2024-01-01 02:00:00"}, {"flare_id": "d"}, {"time": "bad", "flare_id": "e"},
        ]) + "\nbroken\n[]\n",
    },
}


def landed_files(folder, feed):
    for name, body in FILES[feed].items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body.encode())
    (folder / "_SUCCESS").write_text("")
    return str(folder)


def load(spark, feed, folder, **options):
    landed.register(spark)
    return spark.read.format("landed").option("feed", feed).options(**options).load(folder)


def rows(frame):
    return sorted((tuple(r) for r in frame.drop("source_type").collect()), key=repr)


@pytest.mark.parametrize("feed", sorted(FILES))
def test_source_equals_native_parse(spark, tmp_path, feed):
    folder = landed_files(tmp_path, feed)
    got = load(spark, feed, folder)
    assert got.schema == feeds.FEEDS[feed].schema
    assert rows(got) == rows(feeds.read_feed(spark, feed, folder)) and got.count() > 0


@pytest.mark.parametrize("feed", sorted(landed.FORMATS))
def test_every_feed_has_a_format_and_a_parser(spark, tmp_path, feed):
    assert feeds.FEEDS[feed].name == feed and feeds.FEEDS[feed].documents == landed.FORMATS[feed].document
    assert load(spark, feed, str(tmp_path)).count() == 0 and set(landed.FORMATS) == set(feeds.FEEDS)


def test_lines_of_byte_ranges(tmp_path):
    rng, path = random.Random(1), tmp_path / "f"
    for _ in range(60):
        lines = ["é" * rng.choice([0, 0, 1, 5, 40]) + str(i) * rng.randint(0, 2) for i in range(rng.randint(0, 12))]
        path.write_bytes("\n".join(lines).encode() + b"\n" * rng.randint(0, 1))
        size, step = path.stat().st_size, rng.randint(1, 30)
        parts = [list(landed._lines(fs.LocalFileSystem(), str(path), at, min(at + step, size))) for at in range(0, size, step)]
        whole = path.read_text().split("\n")
        assert [x for p in parts for x in p] == (whole[:-1] if whole[-1] == "" else whole) == list(landed._lines(fs.LocalFileSystem(), str(path), 0, -1))


def test_splits_change_nothing(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("".join(f"20240{1 + j % 9}02 170000 1 2 {i}.{j:03d} 11 9\n" for j in range(300)))
    whole = load(spark, "radio_flux", str(tmp_path))
    cut = load(spark, "radio_flux", str(tmp_path), splitBytes="1000")
    assert whole.rdd.getNumPartitions() == 1 and cut.rdd.getNumPartitions() > 20
    assert rows(cut) == rows(whole) and cut.count() == 900


def plan_of(feed, folder, *filters):
    reader = landed.LandedReader(feeds.FEEDS[feed].schema, {"feed": feed, "path": folder})
    left = list(reader.pushFilters(list(filters)))
    return reader, left, [name for p in reader.partitions() for _, name, _, _ in p.parts]


def test_pushed_bounds_skip_files_and_rows(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    folder = landed_files(tmp_path, "dst")
    at = lambda *x: datetime(*x, tzinfo=UTC)
    assert plan_of("dst", folder, GreaterThan(("time_tag",), at(2024, 1, 31, 23)))[2] == ["202401/dst2401.for.request", "nomonth.txt"]
    assert plan_of("dst", folder, LessThan(("time_tag",), at(1996, 2, 1)))[2] == ["1996-02/index.html", "nomonth.txt"]
    reader, left, names = plan_of("dst", folder, EqualTo(("dst",), 1.0), EqualTo(("time_tag",), at(1996, 2, 5)), LessThan(("time_tag",), "x"))
    assert len(left) == 2 and names == ["1996-02/index.html", "nomonth.txt"]
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1]
    every = load(spark, "dst", folder)
    for text in ("time_tag > TIMESTAMP '1996-02-29 00:00:00'", "time_tag >= TIMESTAMP '1996-02-29' AND time_tag <= TIMESTAMP '2024-01-02 01:00:00'", "time_tag = TIMESTAMP '2024-01-31'", "time_tag < TIMESTAMP '1990-01-01'", "dst > 0 AND time_tag IS NOT NULL", "time_tag > TIMESTAMP '2024-01-01' OR dst = 7"):
        want = [r for r in every.collect()]
        kept = spark.createDataFrame(want, every.schema).filter(text)
        assert rows(every.filter(text)) == rows(kept), text


def test_pushed_bounds_show_in_the_plan(spark, tmp_path, capsys):
    frame = load(spark, "dst", landed_files(tmp_path, "dst")).filter("time_tag >= TIMESTAMP '2024-01-02 02:00:00' AND dst > 0")
    frame.explain("formatted")
    lines = capsys.readouterr().out.split("\n")
    pushed = next(x for x in lines if x.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(time_tag" in pushed and "GreaterThan(dst" not in pushed
    assert [x for x in lines if x.startswith("Condition")] and "time_tag" not in next(x for x in lines if x.startswith("Condition"))  # what is left for Spark


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    folder.mkdir()
    landed.register(spark)

    def run():
        stream = spark.readStream.format("landed").option("feed", "radio_flux").option("sourceType", "archive").load(str(folder))
        sink = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
        sink.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.observed_flux, r.source_type) for r in spark.read.schema(stream.schema).parquet(out).collect()) if os.path.exists(out) else []

    for i in range(3):
        (folder / f"{9 - i}.txt").write_text(f"20240102 170000 1 2 {i} 11 9\n")
        os.utime(folder / f"{9 - i}.txt", ns=(10**18 + i, 10**18 + i))
        assert run() == [(float(j), "archive") for j in range(i + 1)]
    assert len(run()) == 3


def test_stream_offsets_do_not_grow(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    stream = landed.LandedStream(feeds.FEEDS["radio_flux"].schema, {"feed": "radio_flux", "path": str(tmp_path), "settleseconds": "0"})
    end = stream.latestOffset()
    assert set(end) == {"time", "path"} and len(stream.partitions(stream.initialOffset(), end)) == 1 and stream.partitions(end, end) == []
    young = landed.LandedStream(feeds.FEEDS["radio_flux"].schema, {"feed": "radio_flux", "path": str(tmp_path), "settleseconds": "1000"})
    assert young.latestOffset() == young.initialOffset()


def test_options_are_checked(spark, tmp_path):
    landed.register(spark)
    with pytest.raises(Exception, match="option feed"):
        spark.read.format("landed").option("feed", "none").load(str(tmp_path)).collect()
