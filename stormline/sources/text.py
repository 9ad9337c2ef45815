"""Parse jobs over landed text and JSON.

Line-based formats take lines as rows `(file, seq, line)`: `read_lines` makes them from files, and
what a line needs to know about its file (where the table begins and ends) travels on chunk context
rows, so a large file is parsed by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormline.functions.lookup import class_to_flux
from stormline.functions.times import event_id
from stormline.operators.fill import carry
from stormline.operators.quality import within_or_null
from stormline.operators.upsert import dedupe_first

LINES_PER_CHUNK = "100000s"  # line numbers are read as seconds

# Catalogue headings and the names they get.
CATALOGUE_NAMES = {
    "CME": "cme_number", "t0": "time_tag", "dt0": "dt_minutes", "pa": "position_angle", "da": "angular_width",
    "v": "median_velocity", "dv": "velocity_variation", "minv": "min_velocity", "maxv": "max_velocity", "halo?": "halo_class",
}
CATALOGUE_NUMBERS = (
    "dt_minutes", "position_angle", "angular_width", "median_velocity", "velocity_variation", "min_velocity", "max_velocity",
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """`(file, seq, line)` of text files, `seq` counting the file's lines from 0.

    A large file is read by many tasks: lines are numbered within their split, and the splits' line counts, one row
    per split, are summed up in the order of the splits.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line")
    )
    splits = lines.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_at", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return lines.join(splits, ["file", "_at"]).select("file", (F.col("_id") + F.col("_shift")).alias("seq"), "line")


def _bounded(lines: DataFrame, opens: Column, closes: Column, keep: Sequence[str], stray: bool = False) -> DataFrame:
    """Lines after the file's first opening line and before its first closing line; `_head` is the opening line.

    With `stray` a closing line before the opening one, or on it, does not count.
    """
    marked = lines.select(
        *keep,
        F.when(opens, F.struct(F.col("seq").alias("at"), F.col("line").alias("text"))).alias("_o"),
        F.when(closes, F.col("seq")).alias("_c"),
    )
    known = carry(
        marked, keys=["file"], ts="seq", series={"_open": ("_o", "min"), "_shut": ("_c", "min")}, chunk=LINES_PER_CHUNK
    )
    if stray:
        known = known.withColumn("_c", F.when(F.col("seq") > F.col("_open.at"), F.col("_c"))).drop("_shut")
        known = carry(known, keys=["file"], ts="seq", series={"_shut": ("_c", "min")}, chunk=LINES_PER_CHUNK)
    inside = (F.col("seq") > F.col("_open.at")) & (F.col("_shut").isNull() | (F.col("seq") < F.col("_shut")))
    return known.filter(inside).select(*keep, F.col("_open.text").alias("_head"))


def parse_pipe_catalogue(lines: DataFrame) -> DataFrame:
    """Rows of the table between a `# CME` heading and a `# Flow` line as a map heading -> cell.

    Comment and blank lines are skipped, cells trimmed, short rows padded with the empty string.
    """
    line = F.col("line")
    body = _bounded(lines, line.startswith("# CME"), line.startswith("# Flow"), ["file", "seq", "line"])
    body = body.filter((F.trim("line") != "") & ~line.startswith("#"))
    heads = F.filter(F.transform(F.split(F.trim(F.regexp_replace("_head", r"^#+", "")), r"\|"), lambda h: F.trim(h)), lambda h: h != "")
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    padded = F.transform(heads, lambda h, i: F.coalesce(F.get(cells, i), F.lit("")))
    return body.select("file", "seq", F.map_from_arrays(heads, padded).alias("cells"))


def catalogue_rows(parsed: DataFrame, month: Column) -> DataFrame:
    """Named, typed catalogue rows with their event id; rows without a time drop out."""
    named = parsed.select("file", "seq", month.cast("date").alias("catalog_month"), *[
        F.try_element_at("cells", F.lit(h)).alias(n) for h, n in CATALOGUE_NAMES.items()
    ])
    typed = named.withColumns({
        "time_tag": F.try_to_timestamp("time_tag", F.lit("yyyy/MM/dd HH:mm")),
        "halo_class": F.nullif(F.trim("halo_class"), F.lit("")),
        "cme_number": F.trim("cme_number"),
        **{c: F.trim(c).try_cast("double") for c in CATALOGUE_NUMBERS},
    })
    return typed.filter("time_tag IS NOT NULL").withColumn("event_id", event_id(F.col("time_tag"), F.col("cme_number")))


def normalize_catalogue(parsed: DataFrame, month: Column, first: str, last: str) -> DataFrame:
    """Named, typed catalogue rows within a range of days, one per event id (the first one met)."""
    after = F.date_add(F.lit(last).cast("date"), 1).cast("timestamp")
    rows = catalogue_rows(parsed, month)
    ranged = rows.filter((F.col("time_tag") >= F.lit(first).cast("timestamp")) & (F.col("time_tag") < after))
    return dedupe_first(ranged, ["event_id"], ["file", "seq"]).drop("file", "seq")


def parse_flare_lines(lines: DataFrame) -> DataFrame:
    """One JSON object a line; the peak flux is that of the class, else the long channel's flux. Rows without id or time drop out."""
    texts, numbers = ("flare_id", "flare_class", "status", "source_day", "satellite", "file_url"), ("xrsb_flux", "background_flux", "integrated_flux")
    r = F.from_json("line", ", ".join(f"{c} string" for c in ("time", "event_time", *texts, *numbers)))
    rows = lines.select(r.alias("r")).select("r.*")
    at = F.try_to_timestamp(F.coalesce(F.nullif("time", F.lit("")), F.col("event_time")))
    rows = rows.select(at.alias("event_time"), *texts, *[F.col(c).try_cast("double").alias(c) for c in numbers])
    peak = class_to_flux(F.trim("flare_class"), F.col("xrsb_flux"))
    return rows.withColumn("peak_flux_wm2", peak).filter("event_time IS NOT NULL AND flare_id <> ''")


def _hours(rows: DataFrame, values: Column, keep: Sequence[str], month: Column, pad: bool) -> DataFrame:
    """One row per (day, hour) of an array of value tokens; impossible dates drop out."""
    spread = rows.select(*keep, "_day", month.cast("date").alias("_m"), F.posexplode(values).alias("_hour", "_token"))
    day = F.format_string("%04d-%02d-%02d", F.year("_m"), F.month("_m"), F.col("_day")).try_cast("date")
    number = within_or_null(F.col("_token").try_cast("int"), -2000, 2000).cast("double")
    at = F.when(F.col("_hour") < 24, F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + F.col("_hour") * F.lit(3_600_000_000)))
    out = spread.select(*keep, at.alias("time_tag"), number.alias("dst")).filter("time_tag IS NOT NULL")
    return out if pad else out.filter("dst IS NOT NULL")


def parse_hourly_matrix(lines: DataFrame, month: Column, keep: Sequence[str] = ("file", "seq")) -> DataFrame:
    """`DST...*DD...` lines: the day follows the star, values follow two leading tokens.

    A minus glued to the previous number starts a new one; tokens that are no integer within
    +-2000 are dropped.
    """
    line = F.col("line")
    loose = F.regexp_replace("line", r"(?<=[^ -])-", " -")
    tokens = F.filter(F.split(F.trim(loose), r"\s+"), lambda t: t != "")
    day = F.trim(F.substr(F.get(F.split("line", r"\*"), F.lit(1)), F.lit(1), F.lit(2))).try_cast("int")
    rows = lines.filter(line.startswith("DST")).withColumn("_day", day).withColumn("_t", tokens)
    rows = rows.filter(F.col("_day").isNotNull() & (F.size("_t") >= 3))
    return _hours(rows, F.slice("_t", F.lit(3), F.size("_t") - 2), keep, month, pad=False)


def parse_pre_block(lines: DataFrame, month: Column, keep: Sequence[str] = ("file", "seq")) -> DataFrame:
    """Integers in the lines of a `<pre>` block: a day, then 24 hours; missing hours are NULL."""
    line = F.col("line")
    body = _bounded(lines, line.contains("<pre"), line.contains("</pre"), [*dict.fromkeys([*keep, "file", "seq", "line"])], stray=True)
    numbers = F.regexp_extract_all("line", F.lit(r"-?\d+"), F.lit(0))
    rows = body.withColumn("_n", numbers).filter(~line.contains("<pre") & (F.size("_n") >= 2))
    rows = rows.withColumn("_day", F.get("_n", F.lit(0)).try_cast("int")).filter(F.col("_day").between(1, 31))
    hours = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.get("_n", i))
    return _hours(rows, hours, keep, month, pad=True)


def parse_flux_table(lines: DataFrame, keep: Sequence[str] = ("file", "seq")) -> DataFrame:
    """Whitespace table in two layouts: 7 tokens (date, time, ..) or at least 9 (.., y, m, d, time, ..)."""
    stripped = F.trim("line")
    heading = stripped.rlike(r"^(Julian|Number|=|-----)") | F.lower(stripped).startswith("fluxdate") | (stripped == "")
    t = F.col("_t")
    rows = lines.filter(~heading).withColumn("_t", F.split(stripped, r"\s+"))
    short = F.size(t) == 7
    rows = rows.filter(short | (F.size(t) >= 9))
    date = F.when(short, t[0]).otherwise(F.concat(F.get(t, F.lit(2)), F.get(t, F.lit(3)), F.get(t, F.lit(4))))
    clock = F.when(short, t[1]).otherwise(F.get(t, F.lit(5)))
    clock = F.when(F.length(clock) <= 4, F.concat(clock, F.lit("00"))).otherwise(clock)
    clock = F.when(F.length(clock) < 6, F.lpad(clock, 6, "0")).otherwise(clock)
    at = F.try_to_timestamp(F.concat(date, clock), F.lit("yyyyMMddHHmmss"))
    values = {n: F.when(short, F.get(t, F.lit(4 + i))).otherwise(F.get(t, F.lit(6 + i))).try_cast("double")
              for i, n in enumerate(("observed_flux", "adjusted_flux", "ursi_flux"))}
    return rows.select(*keep, at.alias("time_tag"), *[v.alias(n) for n, v in values.items()]).filter("time_tag IS NOT NULL")


def parse_json_series(docs: DataFrame, payload: str, time_names: Sequence[str], cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A series from JSON documents of any of three forms: heading row + rows, list of objects, object of lists.

    Names match in any letter case; the first of `time_names` present is the time.  Rows without a
    time drop out, numbers that do not parse are NULL.
    """
    names = [*time_names, *cols]
    text = F.col(payload)
    kind = F.when(F.ltrim(text).startswith("{"), "lists").when(text.rlike(r"^\s*\[\s*\["), "table").otherwise("objects")
    # each document is read once, in its own form; later steps work on the parsed columns
    parsed = docs.select(*keep, text.alias("_doc"), kind.alias("_kind")).select(
        *keep,
        "_kind",
        F.when(F.col("_kind") == "table", F.from_json("_doc", "array<array<string>>")).alias("_table"),
        F.when(F.col("_kind") == "objects", F.from_json("_doc", "array<map<string,string>>")).alias("_objects"),
        F.when(F.col("_kind") == "lists", F.from_json("_doc", "map<string,array<string>>")).alias("_lists"),
    )
    parsed = parsed.withColumns({
        "_heads": F.transform(F.get("_table", F.lit(0)), lambda h: F.lower(h)),
        "_lists": F.transform_keys("_lists", lambda k, _: F.lower(k)),
    })
    # where each wanted name stands in a row (0: nowhere)
    placed = {f"_at{i}": F.coalesce(F.array_position("_heads", n), F.lit(0)).cast("int") for i, n in enumerate(names)}
    parsed = parsed.withColumns({**placed, "_columns": F.array(*[F.try_element_at("_lists", F.lit(n)) for n in names])})
    height = F.array_max(F.transform("_columns", lambda c: F.coalesce(F.size(c), F.lit(0))))
    no_map, no_array = F.lit(None).cast("map<string,string>"), F.lit(None).cast("array<string>")
    rows = (
        F.when(F.col("_kind") == "table", F.transform(F.slice("_table", F.lit(2), F.size("_table")), lambda r: F.struct(r.alias("a"), no_map.alias("m"))))
        .when(
            F.col("_kind") == "objects",
            F.transform("_objects", lambda m: F.struct(no_array.alias("a"), F.transform_keys(m, lambda k, _: F.lower(k)).alias("m"))),
        )
        .when(
            height > 0,
            F.transform(
                F.sequence(F.lit(0), height - 1),
                lambda i: F.struct(F.transform("_columns", lambda c: F.get(c, i)).alias("a"), no_map.alias("m")),
            ),
        )
    )
    spread = parsed.select(*keep, "_kind", *placed, F.explode(rows).alias("_r"))

    def cell(i: int) -> Column:
        in_table = F.when(F.col(f"_at{i}") > 0, F.get("_r.a", F.col(f"_at{i}") - 1))
        return (
            F.when(F.col("_kind") == "table", in_table)
            .when(F.col("_kind") == "lists", F.get("_r.a", F.lit(i)))
            .otherwise(F.try_element_at("_r.m", F.lit(names[i])))
        )

    time = F.coalesce(*[cell(i) for i in range(len(time_names))])
    values = [cell(len(time_names) + i).try_cast("double").alias(c) for i, c in enumerate(cols)]
    return spread.select(*keep, F.try_to_timestamp(time).alias("time_tag"), *values).filter("time_tag IS NOT NULL")
