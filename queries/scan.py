"""Scans, sinks, upserts and parse jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormline.functions.times import coerce_epoch
from stormline.operators.upsert import evolve, upsert_ignore, upsert_replace
from stormline.session import shared_folder
from stormline.sources import feeds, text

from .fixtures import events, hourly, keyed, rounded, table
from .registry import query
from .registry import r6 as s6
from .registry import sql


@query("scan_timeseries", "SELECT ts, event_type, value FROM events WHERE ts IS NOT NULL")
def scan_timeseries(spark, sf_dir):
    return feeds.scan_timeseries(events(spark, sf_dir), "ts", ["event_type", "value"])


@query("scan_detect_time", "SELECT event_id, ts, value FROM events")
def scan_detect_time(spark, sf_dir):
    stage = events(spark, sf_dir).select("event_id", F.col("ts").alias("timestamp"), "value")
    return feeds.detect_time(stage)


@query("sink_roundtrip", sql(f"SELECT k, ts, {s6('v')} AS v, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'train' ELSE 'test' END AS split FROM H", "H"))
def sink_roundtrip(spark, sf_dir):
    path = shared_folder(spark)
    split = F.when(F.col("ts") < "2024-01-16", "train").otherwise("test")
    feeds.write_stage(hourly(spark, sf_dir).drop("n").withColumn("split", split), path)
    return rounded(spark.read.parquet(path), "v")


# two overlapping batches over the same hours: the old one sums values, the new one counts rows
_OLD = "SELECT event_type AS k, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS v FROM events WHERE ts < TIMESTAMP '2024-01-21' GROUP BY 1, 2"
_NEW = "SELECT event_type AS k, date_trunc('hour', ts) AS ts, CAST(event_id AS DOUBLE) AS v, event_id AS seq FROM events WHERE ts >= TIMESTAMP '2024-01-11'"
_HEAD = f"WITH O AS ({_OLD}), N AS ({_NEW}) "


def _batches(spark, sf_dir):
    raw = keyed(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    old = raw.filter(F.col("ts") < "2024-01-21").groupBy("k", F.col("hour").alias("ts")).agg(F.round(F.sum("v"), 2).alias("v"))
    new = raw.filter(F.col("ts") >= "2024-01-11").select("k", F.col("hour").alias("ts"), F.col("event_id").cast("double").alias("v"), F.col("event_id").alias("seq"))
    return old, new


@query("upsert_replace", _HEAD + """, U AS (SELECT k, ts, v, 0 AS b, 0 AS seq FROM O UNION ALL SELECT k, ts, v, 1, seq FROM N)
    SELECT k, ts, v FROM (SELECT *, row_number() OVER (PARTITION BY k, ts ORDER BY b DESC, seq DESC) AS rn FROM U) WHERE rn = 1""")
def replace(spark, sf_dir):
    old, new = _batches(spark, sf_dir)
    return upsert_replace(old, new, ["k", "ts"], ["seq"]).select("k", "ts", "v")


@query("upsert_ignore", _HEAD + """, U AS (SELECT k, ts, v, 0 AS b, 0 AS seq FROM O UNION ALL SELECT k, ts, v, 1, seq FROM N)
    SELECT k, ts, v FROM (SELECT *, row_number() OVER (PARTITION BY k, ts ORDER BY b, seq) AS rn FROM U) WHERE rn = 1""")
def ignore(spark, sf_dir):
    old, new = _batches(spark, sf_dir)
    return upsert_ignore(old, new, ["k", "ts"], ["seq"]).select("k", "ts", "v")


@query("evolve_source_type", "SELECT event_id, value, CASE WHEN ts < TIMESTAMP '2024-01-16' OR event_type = 'error' THEN 'archive' ELSE 'realtime' END AS source_type FROM events")
def evolve_source_type(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "value", "ts", "event_type")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    old, new = df.filter(F.col("ts") < cut), df.filter(F.col("ts") >= cut)
    new = new.withColumn("source_type", F.when(F.col("event_type") != "error", "realtime"))
    return evolve(old, new).select("event_id", "value", "source_type")


# --- text forms built from the events table ---------------------------------------------------

_PIPE = """
    SELECT event_type AS file, event_id + 10 AS seq, CASE
        WHEN event_id % 7 = 0 THEN '# note ' || event_id
        WHEN event_id % 11 = 0 THEN '   '
        WHEN event_id % 13 = 0 THEN event_id || ' | ' || strftime(ts, '%Y/%m/%d %H:%M') || '|12'
        ELSE ' ' || (event_id % 5000) || ' | ' || strftime(ts, '%Y/%m/%d %H:%M') || ' |' || (event_id % 60) || '|' || (event_id % 360) || '|'
             || (event_id % 90) || '|' || (event_id % 1500) || '|' || (event_id % 40) || '|x' || event_id || '|' || (event_id % 2000) || '|'
             || CASE WHEN event_id % 3 = 0 THEN 'II' ELSE ' ' END
        END AS line FROM events
    UNION ALL SELECT DISTINCT event_type, 400, '# CME | t0 | dt0| pa | da | v | dv | minv| maxv| halo?' FROM events
    UNION ALL SELECT event_type, max(event_id) - 50, '# Flow' FROM events GROUP BY 1"""

_PIPE_BODY = """L AS (SELECT file, min(seq) FILTER (line LIKE '# CME%') AS a, min(seq) FILTER (line LIKE '# Flow%') AS b FROM P GROUP BY file),
    C AS (SELECT P.file, seq, string_split(line, '|') AS c FROM P JOIN L ON L.file = P.file
          WHERE seq > a AND seq < b AND trim(line) <> '' AND line NOT LIKE '#%')"""


def pipe_lines(spark, sf_dir):
    df = events(spark, sf_dir)
    i, s = F.col("event_id"), lambda c: c.cast("string")
    time = F.date_format("ts", "yyyy/MM/dd HH:mm")
    full = F.concat(
        F.lit(" "), s(i % 5000), F.lit(" | "), time, F.lit(" |"), s(i % 60), F.lit("|"), s(i % 360), F.lit("|"), s(i % 90), F.lit("|"),
        s(i % 1500), F.lit("|"), s(i % 40), F.lit("|x"), s(i), F.lit("|"), s(i % 2000), F.lit("|"), F.when(i % 3 == 0, "II").otherwise(" "),
    )
    line = (
        F.when(i % 7 == 0, F.concat(F.lit("# note "), s(i))).when(i % 11 == 0, "   ")
        .when(i % 13 == 0, F.concat(s(i), F.lit(" | "), time, F.lit("|12"))).otherwise(full)
    )
    rows = df.select(F.col("event_type").alias("file"), (i + 10).alias("seq"), line.alias("line"))
    ends = df.groupBy(F.col("event_type").alias("file")).agg(F.max("event_id").alias("m"))
    head = ends.select("file", F.lit(400).cast("long").alias("seq"), F.lit("# CME | t0 | dt0| pa | da | v | dv | minv| maxv| halo?").alias("line"))
    return rows.unionByName(head).unionByName(ends.select("file", (F.col("m") - 50).alias("seq"), F.lit("# Flow").alias("line")))


@query("parse_pipe_catalog", f"""WITH P AS ({_PIPE}), {_PIPE_BODY}
    SELECT file, seq, trim(c[1]) AS number, trim(c[2]) AS t0, coalesce(trim(c[3]), '') AS dt0, coalesce(trim(c[8]), '') AS minv, coalesce(trim(c[10]), '') AS halo FROM C""")
def parse_pipe_catalog(spark, sf_dir):
    cells = text.parse_pipe_catalogue(pipe_lines(spark, sf_dir))
    at = {"number": "CME", "t0": "t0", "dt0": "dt0", "minv": "minv", "halo": "halo?"}
    return cells.select("file", "seq", *[F.try_element_at("cells", F.lit(h)).alias(n) for n, h in at.items()])


@query("normalize_catalog", f"""WITH P AS ({_PIPE}), {_PIPE_BODY},
    T AS (SELECT file, seq, trim(c[1]) AS cme_number, strptime(trim(c[2]), '%Y/%m/%d %H:%M') AS time_tag, TRY_CAST(trim(c[3]) AS DOUBLE) AS dt_minutes,
        TRY_CAST(trim(c[4]) AS DOUBLE) AS position_angle, TRY_CAST(trim(c[5]) AS DOUBLE) AS angular_width, TRY_CAST(trim(c[6]) AS DOUBLE) AS median_velocity,
        TRY_CAST(trim(c[7]) AS DOUBLE) AS velocity_variation, TRY_CAST(trim(c[8]) AS DOUBLE) AS min_velocity, TRY_CAST(trim(c[9]) AS DOUBLE) AS max_velocity,
        nullif(trim(c[10]), '') AS halo_class FROM C),
    E AS (SELECT *, strftime(time_tag, '%Y%m%d%H%M') || '-' || CASE WHEN length(cme_number) >= 4 THEN cme_number ELSE lpad(cme_number, 4, '0') END AS event_id
        FROM T WHERE time_tag >= TIMESTAMP '2024-01-03' AND time_tag < TIMESTAMP '2024-01-28')
    SELECT * EXCLUDE (file, seq, rn), DATE '2024-01-01' AS catalog_month FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY file, seq) AS rn FROM E) WHERE rn = 1""")
def normalize_catalog(spark, sf_dir):
    cells = text.parse_pipe_catalogue(pipe_lines(spark, sf_dir))
    return text.normalize_catalogue(cells, F.lit("2024-01-01"), "2024-01-03", "2024-01-27")


_MATRIX = [f"(n * {7 * j + 3} + {31 * j}) % 400 - 250" for j in range(23)] + ["9999"]


@query("parse_hourly_matrix", sql(
    "SELECT k, CAST(date_trunc('month', ts) AS TIMESTAMP) + to_days(CAST(d - 1 AS INTEGER)) + to_hours(CAST(j AS INTEGER)) AS time_tag, seq, CAST(x AS DOUBLE) AS dst "
    "FROM (SELECT *, unnest(range(23)) AS j, unnest(xs) AS x FROM (SELECT *, [" + ", ".join(_MATRIX[:-1]) + "] AS xs FROM M)) WHERE d BETWEEN 1 AND 31",
    "H", M="SELECT k, ts, n, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS seq, n % 33 AS d FROM H"))
def parse_hourly_matrix(spark, sf_dir):
    h = hourly(spark, sf_dir).withColumn("seq", F.expr("CAST((unix_micros(ts) - unix_micros(TIMESTAMP '2024-01-01')) / 3600000000 AS BIGINT)"))
    body = F.concat(*[F.expr(f"concat(CASE WHEN ({e}) < 0 THEN '' ELSE ' ' END, {e})") for e in _MATRIX])
    head = F.concat(F.lit("DST2401*"), F.lpad((F.col("n") % 33).cast("string"), 2, "0"), F.lit("RRX020 000"))
    lines = h.select(F.col("k").alias("file"), "seq", F.concat(head, body).alias("line"), F.to_date(F.date_trunc("month", "ts")).alias("m"))
    out = text.parse_hourly_matrix(lines, F.col("m"))
    return out.select(F.col("file").alias("k"), "time_tag", "seq", "dst")


@query("parse_pre_block", sql(
    "SELECT k, seq, CAST(date_trunc('month', ts) AS TIMESTAMP) + to_days(CAST(d - 1 AS INTEGER)) + to_hours(CAST(j AS INTEGER)) AS time_tag, CAST(x AS DOUBLE) AS dst "
    "FROM (SELECT *, unnest(range(24)) AS j, unnest([n - 9, -n, n % 5, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL]) AS x FROM M) "
    "WHERE seq > 30 AND seq < 700 AND d BETWEEN 1 AND 31",
    "H", M="SELECT k, ts, n, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS seq, 1 + n % 34 AS d FROM H"))
def parse_pre_block(spark, sf_dir):
    h = hourly(spark, sf_dir).withColumn("seq", F.expr("CAST((unix_micros(ts) - unix_micros(TIMESTAMP '2024-01-01')) / 3600000000 AS BIGINT)"))
    line = F.format_string("%d : %d %d %d", 1 + F.col("n") % 34, F.col("n") - 9, -F.col("n"), F.col("n") % 5)
    rows = h.select(F.col("k").alias("file"), "seq", line.alias("line"))
    tags = h.select(F.col("k").alias("file")).distinct()
    for at, tag in ((30, "<pre class='data'>"), (700, "</pre>")):
        rows = rows.filter(F.col("seq") != at).unionByName(tags.select("file", F.lit(at).cast("long").alias("seq"), F.lit(tag).alias("line")))
    out = text.parse_pre_block(rows, F.lit("2024-01-01"))
    return out.select(F.col("file").alias("k"), "seq", "time_tag", "dst")


@query("parse_flux_table", """SELECT o_orderkey AS seq,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(30)
         ELSE o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(5) + to_seconds(7) END AS time_tag,
    CAST(o_custkey % 300 AS DOUBLE) + 0.5 AS observed_flux, CAST(o_custkey % 200 AS DOUBLE) AS adjusted_flux,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 100 AS DOUBLE) END AS ursi_flux FROM orders WHERE o_orderkey % 7 <> 0""")
def parse_flux_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key, cust, s = F.col("o_orderkey"), F.col("o_custkey"), lambda c: c.cast("string")
    hour = F.lpad(s(key % 24), 2, "0")
    tail = F.concat(s(cust % 300), F.lit(".5  "), s(cust % 200), F.lit(" "), F.when(key % 5 == 0, "n/a").otherwise(s(cust % 100)))
    nine = F.concat(F.lit("  2450000.1 2200 "), F.date_format("o_orderdate", "yyyy MM dd "), hour, F.lit("30 "), tail, F.lit(" end"))
    seven = F.concat(F.date_format("o_orderdate", "yyyyMMdd "), F.regexp_replace(hour, "^0", ""), F.lit("0507 2450000.1 2200 "), tail)
    line = F.when(key % 7 == 0, "fluxdate    fluxtime").when(key % 3 == 0, nine).otherwise(seven)
    return text.parse_flux_table(o.select(key.alias("seq"), line.alias("line")), keep=["seq"])


@query("parse_json_series", """SELECT event_id, ts_s AS time_tag, CAST(k AS DOUBLE) AS bz, CASE WHEN event_id % 4 <> 0 THEN round(value, 2) END AS bt
    FROM (SELECT event_id, date_trunc('second', ts) AS ts_s, CAST(props->>'k' AS INTEGER) AS k, value FROM events)""")
def parse_json_series(spark, sf_dir):
    df = events(spark, sf_dir)
    time, k = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.get_json_object("props", "$.k")
    v = F.when(F.col("event_id") % 4 == 0, "bad").otherwise(F.col("value").cast("string"))
    head = F.format_string('[["Time_Tag","BZ","other","Bt"],["%s","%s","1","%s"],["never","1","2","3"]]', time, k, v)
    objects = F.format_string('[{"time":"%s","Bz":%s,"BT":"%s"},{"time":null,"Bz":1,"BT":"2"}]', time, k, v)
    lists = F.format_string('{"datetime":["%s"],"bz":[%s],"bt":["%s"],"meta":["x"]}', time, k, v)
    form = F.when(F.col("event_id") % 3 == 0, head).when(F.col("event_id") % 3 == 1, objects).otherwise(lists)
    docs = df.select("event_id", form.alias("payload"))
    return text.parse_json_series(docs, "payload", ["time_tag", "time", "datetime"], ["bz", "bt"], keep=["event_id"])


@query("coerce_epoch", "SELECT event_id, date_trunc('second', ts) AS from_text, date_trunc('second', ts) AS from_s, date_trunc('milliseconds', ts) AS from_ms, ts AS from_us FROM events")
def epoch(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    us = F.unix_micros("ts")
    df = df.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"),
        F.floor(us / 1_000_000).cast("string").alias("s"),
        F.floor(us / 1_000).cast("string").alias("ms"),
        us.cast("string").alias("us"),
    )
    df = coerce_epoch(df, {"t": "from_text", "s": "from_s", "ms": "from_ms", "us": "from_us"})
    return df.select("event_id", "from_text", "from_s", "from_ms", "from_us")


@query("route_segments", """SELECT event_id, ts, value, 'archive' AS dataset FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15'
    UNION ALL SELECT event_id, ts, value, 'realtime' FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-26'""")
def route_segments(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "ts", "value")
    return feeds.route_segments(df, df, "ts", start="2024-01-05", end="2024-01-25", realtime_from="2024-01-15")


SATELLITES = [
    ("east-8", 8, "1995-01-01", "1996-06-30"), ("west-10", 10, "1996-01-01", "1998-12-31"), ("east-9", 9, "1997-03-01", "1999-03-01"),
    ("west-12", 12, "1999-01-01", None), ("east-11", 11, "2000-02-01", None),
]
_SAT = "S(name, num, ord, a, b) AS (VALUES " + ", ".join(
    f"('{n}', {k}, {i}, DATE '{a}', {'NULL' if b is None else f'DATE {b!r}'})" for i, (n, k, a, b) in enumerate(SATELLITES)
) + ")"


def _sat_sql(pick: str) -> str:
    return f"""WITH {_SAT}, D AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
        SELECT day, {pick} AS satellite FROM D JOIN S ON day >= a AND (b IS NULL OR day <= b) GROUP BY day"""


def _days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


@query("effective_latest", _sat_sql("arg_max(name, num)"))
def effective_latest(spark, sf_dir):
    return feeds.effective(_days(spark, sf_dir), "day", SATELLITES)


@query("effective_first", _sat_sql("arg_min(name, ord)"))
def effective_first(spark, sf_dir):
    return feeds.effective(_days(spark, sf_dir), "day", SATELLITES, first_match=True)


@query("pending_windows", """WITH M AS (SELECT o_custkey AS source, CAST(max(o_orderdate) AS DATE) AS mark FROM orders GROUP BY 1),
    W AS (SELECT source, unnest(generate_series(CAST(mark + 1 AS TIMESTAMP), TIMESTAMP '2001-12-31', INTERVAL 30 DAY)) AS s FROM M WHERE mark + 1 <= DATE '2001-12-31')
    SELECT source, CAST(s AS DATE) AS start, least(CAST(s AS DATE) + 29, DATE '2001-12-31') AS "end" FROM W""")
def pending_windows(spark, sf_dir):
    marks = feeds.high_water_mark(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "source"), "source", ["o_orderdate"])
    return feeds.pending_windows(marks, "source", "latest_timestamp", "2001-12-31", 30)


@query("snapshot_latest", """WITH A AS (SELECT o_orderkey AS id, o_orderdate AS ts, 'orders' AS source FROM orders UNION ALL SELECT l_orderkey, l_shipdate, 'lineitem' FROM lineitem)
    SELECT * FROM A WHERE ts >= (SELECT max(ts) FROM A) - INTERVAL 4320 HOUR""")
def snapshot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts"))
    return feeds.snapshot_latest({"orders": (o, "ts"), "lineitem": (li, "ts")}, 4320)
