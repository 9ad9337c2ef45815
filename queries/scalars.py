"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormline.functions import lookup as L
from stormline.functions import times as T
from stormline.operators import resample as A

from .fixtures import events, keyed, r6, table
from .registry import query
from .registry import r6 as s6


@query("event_id", "SELECT event_id AS id, strftime(ts, '%Y%m%d%H%M') || '-' || CASE WHEN event_id < 1000 THEN lpad(CAST(event_id AS VARCHAR), 4, '0') ELSE CAST(event_id AS VARCHAR) END AS event_id, trim('  ' || upper(event_type) || ' ') AS label FROM events")
def event_id(spark, sf_dir):
    df = events(spark, sf_dir)
    label = F.trim(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))
    return df.select(F.col("event_id").alias("id"), T.event_id(F.col("ts"), F.col("event_id").cast("string")).alias("event_id"), label.alias("label"))


_CLS = "CASE event_id % 8 WHEN 0 THEN 'a' WHEN 1 THEN 'B' WHEN 2 THEN 'c' WHEN 3 THEN 'M' WHEN 4 THEN 'X' WHEN 5 THEN 'Z' WHEN 6 THEN '' ELSE 'Mx' END"


@query("class_to_flux", f"""SELECT event_id, cls, {s6("flux * 1e6")} AS micro_flux FROM (SELECT *, coalesce(CASE upper(cls[1:1]) WHEN 'A' THEN 1e-8 WHEN 'B' THEN 1e-7 WHEN 'C' THEN 1e-6 WHEN 'M' THEN 1e-5 WHEN 'X' THEN 1e-4 END
    * CASE WHEN cls[2:] = '' THEN 0 ELSE TRY_CAST(cls[2:] AS DOUBLE) END, CASE WHEN event_id % 2 = 0 THEN 1e-9 * (event_id % 100) END) AS flux
    FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN {_CLS} ELSE {_CLS} || (event_id % 10) || '.' || (event_id % 7) END AS cls FROM events))""")
def class_to_flux(spark, sf_dir):
    i = F.col("event_id")
    letter = F.element_at(F.array(*[F.lit(x) for x in ("a", "B", "c", "M", "X", "Z", "", "Mx")]), (i % 8 + 1).cast("int"))
    cls = F.when(i % 9 == 0, letter).otherwise(F.concat(letter, (i % 10).cast("string"), F.lit("."), (i % 7).cast("string")))
    df = events(spark, sf_dir).select("event_id", cls.alias("cls"))
    flux = L.class_to_flux(F.col("cls"), F.when(i % 2 == 0, 1e-9 * (i % 100)))
    return df.select("event_id", "cls", r6(flux * 1e6).alias("micro_flux"))


@query("filename_date", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 4 THEN NULL WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def filename_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = lambda form: F.date_format("o_orderdate", form)
    names = [
        F.concat(F.lit("sci_xrsf-l2_d"), at("yyyyMMdd"), F.lit("_v1.nc")),
        F.concat(F.lit("list/"), at("yyyy-MM-dd"), F.lit(".txt")),
        F.concat(F.lit("ac_h3_"), at("yyyyMMdd"), F.lit("_v01.cdf")),
        F.concat(F.lit("DST"), at("yyMMdd"), F.lit(".for")),
        F.lit("readme.txt"),
        F.lit("run_20011399_x.bin"),
    ]
    name = F.element_at(F.array(*names), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), T.filename_date(name, ["dst"]).alias("day"))


@query("latest_file", "SELECT o_custkey AS source, max(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY 1")
def latest_file(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("oe_f1m_d"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T00.nc"))
    return o.groupBy(F.col("o_custkey").alias("source")).agg(F.max(T.filename_date(name)).alias("day"))


@query("time_floor_ceil", """SELECT event_id, date_trunc('hour', ts) AS floor_h, CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS ceil_h, ts + INTERVAL 1 HOUR AS shifted,
    CAST(date_trunc('month', ts) AS DATE) AS month_start, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events""")
def time_floor_ceil(spark, sf_dir):
    df = keyed(spark, sf_dir)
    return df.select(
        "event_id", A.floor_time("ts", "1h").alias("floor_h"), A.ceil_time("ts", "1h").alias("ceil_h"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("shifted"), F.to_date(F.trunc("ts", "month")).alias("month_start"),
        F.to_date("ts").alias("day"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"),
    )


@query("math_functions", f"""SELECT event_id, {s6('atan2(value - 50, k)')} AS angle, {s6('sin(value)')} AS sine, {s6('cos(radians(value))')} AS cosine, {s6('pow(value, 1.0 / 3)')} AS root,
    {s6('exp(-value / 36)')} AS decay, {s6('ln(value + 1)')} AS log_1p, {s6('log10(value + 1)')} AS log_10, {s6('abs(value - 50)')} AS size, round_even(k / 8.0::DOUBLE, 2) AS half_even
    FROM (SELECT event_id, value, CAST(props->>'k' AS DOUBLE) AS k FROM events)""")
def math_functions(spark, sf_dir):
    v, k = F.col("v"), F.get_json_object("props", "$.k").cast("double")
    return keyed(spark, sf_dir).select(
        "event_id", r6(F.atan2(v - 50, k)).alias("angle"), r6(F.sin(v)).alias("sine"), r6(F.cos(F.radians(v))).alias("cosine"), r6(F.pow(v, F.lit(1.0 / 3))).alias("root"),
        r6(F.exp(-v / 36)).alias("decay"), r6(F.log1p(v)).alias("log_1p"), r6(F.log10(v + 1)).alias("log_10"), r6(F.abs(v - 50)).alias("size"), F.bround(k / 8, 2).alias("half_even"),
    )


@query("bucket_right_closed", "SELECT event_id, CAST(CASE WHEN b <= 2 THEN 0 WHEN b <= 4 THEN 1 WHEN b <= 6 THEN 2 ELSE 3 END AS INTEGER) AS regime, CAST(CASE WHEN a <= 10 THEN 0 WHEN a <= 30 THEN 1 WHEN a <= 80 THEN 2 WHEN a <= 200 THEN 3 ELSE 4 END AS INTEGER) AS level FROM (SELECT event_id, floor(value / 5) / 2 AS b, floor(value) * 3 AS a FROM events)")
def bucket_right_closed(spark, sf_dir):
    df = keyed(spark, sf_dir)
    return df.select(
        "event_id", L.bucket_right_closed(F.floor(F.col("v") / 5) / 2, L.KP_REGIME).alias("regime"), L.bucket_right_closed(F.floor("v") * 3, L.AP_LEVEL).alias("level")
    )
