"""Streams against their batch forms, over several files and a restart."""

import numpy as np
import pandas as pd
from helpers import START, collect, same, to_spark
from pyspark.sql import functions as F

from stormline.operators.resample import resample
from stormline.streaming import refresh as R

SCHEMA = "k string, ts timestamp, v double, seq long"


def landed(spark, folder, parts=3):
    rng = np.random.default_rng(1)
    n = 300
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], n), "ts": START + pd.to_timedelta(np.sort(rng.integers(0, 86400 * 10, n)), unit="s"), "v": rng.random(n), "seq": range(n)})
    for i in range(parts):
        to_spark(spark, pdf.iloc[i * n // parts : (i + 1) * n // parts]).coalesce(1).write.mode("append").parquet(folder)
    return pdf


def test_hourly_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    landed(spark, folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    hours = R.hourly_stream(stream, keys=["k"], ts="ts", value="v", late="2 days")
    out = str(tmp_path / "out")
    sink = hours.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append")
    sink.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(folder)
    closed = rows.agg(F.max("ts") - F.expr("INTERVAL 2 DAYS")).head()[0]
    batch = resample(rows, {"v": F.avg("v")}, keys=["k"], ts="ts", empty=False).filter(F.expr("ts + INTERVAL 1 HOUR") <= F.lit(closed))
    got, want = collect(spark.read.parquet(out), "k", "ts"), collect(batch, "k", "ts")
    assert list(got["ts"]) == list(want["ts"])
    same(got["v"], want["v"])


def test_last_value_survives_a_restart(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:012d}")

    for _ in range(2):  # the second round starts from the stored state
        landed(spark, folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        newest = R.last_value_stream(stream, key="k", ts="ts", value="v")
        query = newest.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()
    late = to_spark(spark, pd.DataFrame({"k": ["a"], "ts": [START], "v": [9.0], "seq": [1]}))
    late.write.mode("append").parquet(folder)
    query.trigger(availableNow=True).start().awaitTermination()
    got = collect(R.read_upserts(spark, out, ["k"]), "k")
    want = spark.read.parquet(folder).groupBy("k").agg(F.max("ts").alias("ts"))
    assert list(got["ts"]) == list(collect(want, "k")["ts"])


def test_upsert_stream(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    pdf = landed(spark, folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("day", F.to_date("ts"))
    R.upsert_stream(stream, out, str(tmp_path / "c"), ["k", "day"], ["ts", "seq"]).awaitTermination()
    got = collect(R.read_upserts(spark, out, ["k", "day"]), "k", "day")
    pdf["day"] = pdf["ts"].dt.date
    assert list(got["seq"]) == list(pdf.sort_values("seq").groupby(["k", "day"])["seq"].last())
    R.compact_upserts(spark, out, str(tmp_path / "folded"), ["k", "day"])
    pd.testing.assert_frame_equal(collect(R.read_upserts(spark, str(tmp_path / "folded"), ["k", "day"]), "k", "day"), got)


def test_tail_fill_and_retention(spark):
    pdf = pd.DataFrame({"k": "a", "ts": START + pd.to_timedelta(range(72), unit="h"), "v": 1.0})
    old = to_spark(spark, pdf)
    fresh = to_spark(spark, pdf.assign(v=2.0).iloc[40:])
    out = collect(R.rewrite_tail(old, fresh, keys=["k"], ts="ts", as_of="2024-01-04 09:00:00"), "ts")
    assert list(out["v"]) == [1.0] * 36 + [2.0] * 32 and len(out) == 68  # noon two days before; hours 36..39 were not fetched again
    tagged = old.withColumn("source_type", F.lit(None).cast("string"))
    longer = R.extend_to_now(tagged, keys=["k"], ts="ts", as_of="2024-01-04 05:30:00")
    filled = collect(longer.filter("source_type = 'forward_fill'"), "ts")
    assert list(filled["ts"].dt.hour) == [0, 1, 2, 3, 4, 5] and R.clear_fills(longer).count() == 72
    assert R.retain(old, "ts", "2024-01-03 23:00:00", 10).count() == 11
    resume = R.resume_point(old, keys=["k"], ts="ts", start="2023-01-01").head()["resume"]
    assert str(resume) == "2024-01-01"
