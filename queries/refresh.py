"""Incremental refresh: tails, fills, retention, predictions, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormline.operators import joins as J
from stormline.plans.horizons import append_predictions
from stormline.session import shared_folder
from stormline.streaming import refresh as R

from .fixtures import hourly, r6, rounded, table
from .joins import _HS, _LONG, _PIVOT, _long
from .registry import query
from .registry import r6 as s6
from .registry import sql

AS_OF = "2024-01-27 09:30:00"
_TAIL = "TIMESTAMP '2024-01-25 12:00:00'"


@query("tail_rewrite", sql(f"SELECT k, ts, CASE WHEN ts < {_TAIL} THEN {s6('v')} ELSE {s6('v * 2')} END AS v FROM H WHERE ts < {_TAIL} OR n > 1", "H"))
def tail_rewrite(spark, sf_dir):
    h = hourly(spark, sf_dir)
    fresh = h.filter("n > 1").select("k", "ts", (F.col("v") * 2).alias("v"))
    return rounded(R.rewrite_tail(h.drop("n"), fresh, keys=["k"], ts="ts", as_of=AS_OF), "v")


@query("resume_point", "SELECT o_custkey AS c, greatest(DATE '2001-06-01', CAST(max(o_orderdate) - INTERVAL 2 DAY AS DATE)) AS resume FROM orders GROUP BY 1")
def resume_point(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("ts"))
    return R.resume_point(o, keys=["c"], ts="ts", start="2001-06-01")


_EXT = "2024-02-02 07:30:00"
_FILL = f"""SELECT k, ts, {s6('v')} AS v, CAST(NULL AS VARCHAR) AS source_type FROM H UNION ALL
    SELECT k, unnest(generate_series(ts + INTERVAL 1 HOUR, TIMESTAMP '{_EXT}', INTERVAL 1 HOUR)), {s6('v')}, 'forward_fill' FROM (SELECT k, max(ts) AS ts, arg_max(v, ts) AS v FROM H GROUP BY k)"""


def _extended(spark, sf_dir):
    h = rounded(hourly(spark, sf_dir).drop("n"), "v").withColumn("source_type", F.lit(None).cast("string"))
    return R.extend_to_now(h, keys=["k"], ts="ts", as_of=_EXT)


@query("extend_to_now", sql(_FILL, "H"))
def extend_to_now(spark, sf_dir):
    return _extended(spark, sf_dir)


@query("clear_fills", sql(f"SELECT k, ts, {s6('v')} AS v, CAST(NULL AS VARCHAR) AS source_type FROM H", "H"))
def clear_fills(spark, sf_dir):
    return R.clear_fills(_extended(spark, sf_dir))


@query("retention", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-09-01' - INTERVAL 4320 HOUR")
def retention(spark, sf_dir):
    return R.retain(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate", "2001-09-01", 4320)


@query("append_predictions", sql(
    f"SELECT ts, CASE WHEN date_part('hour', ts) >= 6 THEN {s6('p_h2')} ELSE {s6('p_h1')} END AS p FROM P", "G", L=_LONG, P=_PIVOT))
def predictions(spark, sf_dir):
    both = J.pivot_horizons(_long(spark, sf_dir), on=["ts"], horizon="h", value="p", horizons=_HS)
    stored = both.select("ts", r6("p_h1").alias("p"))
    fresh = both.filter(F.hour("ts") >= 6).select("ts", r6("p_h2").alias("p"))
    return append_predictions(stored, fresh)


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return files.select(F.col("event_type").alias("k"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("v"))


@query("stream_hourly", sql(f"SELECT k, ts, {s6('v')} AS v FROM H WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY", "H"))
def stream_hourly(spark, sf_dir):
    root = shared_folder(spark)
    hours = R.hourly_stream(_stream(spark, sf_dir), keys=["k"], ts="ts", value="v")
    sink = hours.writeStream.format("parquet").option("path", f"{root}/hours").option("checkpointLocation", f"{root}/marks")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(hours.schema).parquet(f"{root}/hours"), "v")


@query("stream_last_value", "SELECT event_type AS k, max(ts) AS ts, arg_max(value, ts) AS v FROM events GROUP BY 1")
def stream_last_value(spark, sf_dir):
    root = shared_folder(spark)
    newest = R.last_value_stream(_stream(spark, sf_dir), key="k", ts="ts", value="v")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/newest/batch={number:012d}")

    newest.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{root}/marks").trigger(availableNow=True).start().awaitTermination()
    return R.read_upserts(spark, f"{root}/newest", ["k"])


@query("stream_upsert", "SELECT k, hour, event_id, v FROM (SELECT event_type AS k, date_trunc('hour', ts) AS hour, event_id, value AS v, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_upsert(spark, sf_dir):
    root = shared_folder(spark)
    rows = _stream(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    R.upsert_stream(rows, f"{root}/rows", f"{root}/marks", ["k", "hour"], ["ts", "event_id"]).awaitTermination()
    return R.read_upserts(spark, f"{root}/rows", ["k", "hour"]).select("k", "hour", "event_id", "v")
