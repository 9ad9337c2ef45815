"""Landed feed files as a data source, in batches and as a stream.

    landed.register(spark)
    spark.read.format("landed").option("feed", "dst").load(folder)
    spark.readStream.format("landed").option("feed", "dst").load(folder)

A scan is planned by files: large ones of line formats are cut at `splitBytes`, small ones are read several to a task. Bounds
on the feed's time are taken over from the query: files whose name gives a month outside them are not opened, and rows
outside them never leave the reader. A stream's offset is the time and path of the last file taken, so it does not grow;
a file is taken once, when it is at least `settleSeconds` old.

`Feed.parse` reads the same formats from a frame of lines with Spark's own functions; both give the same rows.
"""

from __future__ import annotations

import calendar
import json
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

SPLIT_BYTES, BATCH_ROWS = 64 << 20, 10_000
UTC = timezone.utc
_MONTH = re.compile(r"(?<!\d)([1-9]\d{3})[-_]?(0[1-9]|1[0-2])")
_INTEGER = re.compile(r"[+-]?\d+")
_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")

Row = dict[str, object]


def month_of(path: str) -> date | None:
    """The first year and month in a path below the loaded folder: `199201`, `1992-01` or `1992_01`."""
    found = _MONTH.search(path)
    return date(int(found[1]), int(found[2]), 1) if found else None


def number(text: object) -> float | None:
    """A plain decimal number; anything else, a NaN too, is missing."""
    return float(text) if isinstance(text, (int, float)) and not isinstance(text, bool) and text == text else float(text) if isinstance(text, str) and _NUMBER.fullmatch(text) else None


def instant(text: object) -> datetime | None:
    """ISO date and time, in UTC unless it names an offset."""
    try:
        at = datetime.fromisoformat(text.strip()) if isinstance(text, str) else None
    except ValueError:
        return None
    return at if at is None or at.tzinfo else at.replace(tzinfo=UTC)


def clock(text: str, pattern: str) -> datetime | None:
    try:
        return datetime.strptime(text, pattern).replace(tzinfo=UTC)
    except ValueError:
        return None


def _hours(month: date, day: int, tokens: Iterable[str | None], pad: bool) -> Iterator[Row]:
    if not 1 <= day <= calendar.monthrange(month.year, month.month)[1]:
        return
    start = datetime(month.year, month.month, day, tzinfo=UTC)
    for hour, token in enumerate(islice(tokens, 24)):
        value = float(token) if token is not None and _INTEGER.fullmatch(token) and -2000 <= int(token) <= 2000 else None
        if pad or value is not None:
            yield {"time_tag": start + timedelta(hours=hour), "dst": value}


def hourly_lines(lines: Iterable[str], month: date | None) -> Iterator[Row]:
    """`DST...*DD...` lines: hours behind two leading tokens; a minus glued to a number starts a new one."""
    for line in lines:
        if line.startswith("DST") and month:
            day = line.partition("*")[2].partition("*")[0][:2].strip()
            tokens = re.sub(r"(?<=[^ -])-", " -", line).split()
            if _INTEGER.fullmatch(day) and len(tokens) >= 3:
                yield from _hours(month, int(day), tokens[2:], pad=False)


def hourly_block(lines: Iterable[str], month: date | None) -> Iterator[Row]:
    """Integers of the first `<pre>` block: a day, then 24 hours; absent hours are missing values."""
    inside = False
    for line in lines:
        if "<pre" in line:
            inside = True
        elif inside and "</pre" in line:
            return
        elif inside and month:
            numbers = re.findall(r"-?\d+", line)
            if len(numbers) >= 2:
                yield from _hours(month, int(numbers[0]), [*numbers[1:], *[None] * 24], pad=True)


def catalogue(lines: Iterable[str], month: date | None) -> Iterator[Row]:
    """Cells of the table between the `# CME` heading and the `# Flow` line."""
    from stormline.sources.text import CATALOGUE_NAMES, CATALOGUE_NUMBERS

    heads: list[str] = []
    for line in lines:
        if not heads:
            if line.startswith("# CME"):
                heads = [h.strip() for h in line.lstrip("#").split("|") if h.strip()]
            continue
        if line.startswith("# Flow"):
            return
        if line.startswith("#") or not line.strip():
            continue
        cells = [c.strip() for c in line.split("|")]
        row: Row = {CATALOGUE_NAMES[h]: (cells[i] if i < len(cells) else "") for i, h in enumerate(heads) if h in CATALOGUE_NAMES}
        at = clock(row.get("time_tag", ""), "%Y/%m/%d %H:%M")
        if at is None:
            continue
        name = row.get("cme_number") or ""
        yield row | {c: number(row.get(c)) for c in CATALOGUE_NUMBERS} | {
            "time_tag": at, "halo_class": row.get("halo_class") or None, "event_id": f"{at:%Y%m%d%H%M}-{name.rjust(4, '0')}", "catalog_month": month,
        }


def flux_table(lines: Iterable[str], month: date | None) -> Iterator[Row]:
    """White-space table in two layouts: date and time first (7 tokens), or behind two other tokens (9 or more)."""
    for line in lines:
        t = line.split()
        if not t or re.match(r"Julian|Number|=|-----", line.strip()) or t[0].lower().startswith("fluxdate") or (len(t) != 7 and len(t) < 9):
            continue
        day, time, values = (t[0], t[1], t[4:7]) if len(t) == 7 else ("".join(t[2:5]), t[5], t[6:9])
        time = time + "00" if len(time) <= 4 else time
        at = clock(day + time.rjust(6, "0"), "%Y%m%d%H%M%S") if len(day) == 8 else None
        if at:
            yield {"time_tag": at} | dict(zip(("observed_flux", "adjusted_flux", "ursi_flux"), map(number, values)))


def json_series(text: str, times: tuple[str, ...], names: dict[str, str]) -> Iterator[Row]:
    """A series from a heading row and rows, a list of objects, or an object of lists; names in any letter case."""
    try:
        given = json.loads(text)
    except ValueError:
        return
    if isinstance(given, dict):
        lists = {k.lower(): v for k, v in given.items() if isinstance(v, list)}
        used = {k: lists[k] for k in (*times, *names) if k in lists}
        objects = [{k: v[i] for k, v in used.items() if i < len(v)} for i in range(max(map(len, used.values()), default=0))]
    elif isinstance(given, list) and given and isinstance(given[0], list):
        heads = [str(h).lower() for h in given[0]]
        objects = [dict(zip(heads, r)) for r in given[1:] if isinstance(r, list)]
    else:
        objects = [{k.lower(): v for k, v in r.items()} for r in given if isinstance(r, dict)] if isinstance(given, list) else []
    for r in objects:
        at = instant(next((r[t] for t in times if r.get(t) is not None), None))
        if at:
            row: Row = {"time_tag": at}
            for name, to in names.items():
                if row.get(to) is None:
                    row[to] = number(r.get(name))
            yield row


def flare_lines(lines: Iterable[str], month: date | None) -> Iterator[Row]:
    """One JSON object a line; the peak flux is that of the class, else the long channel's flux. Rows without id or time drop out."""
    from stormline.functions.lookup import FLARE_SCALE

    for line in lines:
        try:
            r = json.loads(line)
        except ValueError:
            continue
        at = instant(r.get("time") or r.get("event_time")) if isinstance(r, dict) else None
        if at and r.get("flare_id"):
            kind = str(r.get("flare_class") or "").strip()
            size = (number(kind[1:]) if kind[1:] else 0.0) if kind[:1].upper() in FLARE_SCALE else None
            peak = FLARE_SCALE[kind[:1].upper()] * size if size is not None else number(r.get("xrsb_flux"))
            texts = {c: None if r.get(c) is None else str(r[c]) for c in ("flare_id", "flare_class", "status", "source_day", "satellite", "file_url")}
            yield {"event_time": at, "peak_flux_wm2": peak} | {c: number(r.get(c)) for c in ("xrsb_flux", "background_flux", "integrated_flux")} | texts


@dataclass(frozen=True)
class Format:
    """How a feed's files are read: by lines, which can be cut anywhere, by lines of whole files, or as one document."""

    rows: Callable
    cut: bool = True
    document: bool = False
    by_month: bool = False  # all times lie in the month of the file's name


@dataclass
class Piece(InputPartition):
    """(path, name, start, end) of the parts of files that one task reads; end -1 is the whole file."""

    parts: list[tuple[str, str, int, int]]


@dataclass
class Bounds:
    """A range of times, each end with whether it belongs to the range."""

    low: datetime | None = None
    low_in: bool = True
    high: datetime | None = None
    high_in: bool = True

    def above(self, at: datetime, inside: bool) -> None:
        if self.low is None or (at, not inside) > (self.low, not self.low_in):
            self.low, self.low_in = at, inside

    def below(self, at: datetime, inside: bool) -> None:
        if self.high is None or (at, inside) < (self.high, self.high_in):
            self.high, self.high_in = at, inside

    def hold(self, at: datetime) -> bool:
        return (self.low is None or at > self.low or self.low_in and at == self.low) and (self.high is None or at < self.high or self.high_in and at == self.high)

    def meet(self, month: date) -> bool:
        first = datetime(month.year, month.month, 1, tzinfo=UTC)
        after = (first + timedelta(days=32)).replace(day=1)
        return (self.low is None or self.low < after) and (self.high is None or self.high >= first)


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def _listed(path: str) -> list[tuple[int, str, str, int]]:
    """(time in nanoseconds, path, path below the folder, bytes) of the files below a folder; hidden ones are left out."""
    from pyarrow import fs

    system, root = _filesystem(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    own = [(f.mtime_ns or 0, f.path, f.path[len(root.rstrip("/")) + 1 :], f.size) for f in found if f.is_file]
    return sorted(x for x in own if not any(part[:1] in "_." for part in x[2].split("/")))


def _lines(system, path: str, start: int, end: int) -> Iterator[str]:
    """Lines that begin within the byte range; a line belongs to the part in which it begins."""
    with system.open_input_file(path) as file:
        size = file.size()
        end = size if end < 0 else min(end, size)
        at = max(start - 1, 0)
        file.seek(at)
        rest, skip = b"", start > 0
        while at < end or rest:
            block = file.read(1 << 20)
            data = rest + block
            begin = at - len(rest)
            pieces = data.split(b"\n")
            rest = pieces.pop() if block else b""
            for piece in pieces:
                if skip:
                    skip = False
                elif begin >= end:
                    return
                else:
                    yield piece.decode("utf-8", "replace").rstrip("\r")
                begin += len(piece) + 1
            at += len(block)
            if not block:
                return


class _Files:
    """What batch and stream readers share: planning of pieces and reading of one."""

    def __init__(self, schema: StructType, options: dict):
        from stormline.sources.feeds import FEEDS

        self.schema, self.path = schema, options["path"]
        self.feed = options["feed"]
        self.time = FEEDS[self.feed].time
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.source_type = options.get("sourcetype", "realtime")
        self.bounds = Bounds()

    def plan(self, files: list[tuple[int, str, str, int]]) -> list[Piece]:
        out, held, size = [], [], 0
        for _, path, name, length in files:
            form = FORMATS[self.feed]
            month = month_of(name)
            if form.by_month and month and not self.bounds.meet(month):
                continue
            if form.cut and length > self.split and not name.endswith((".html", ".htm")):
                out += [Piece([(path, name, at, min(at + self.split, length))]) for at in range(0, length, self.split)]
                continue
            if held and size + length > self.split:
                out.append(Piece(held))
                held, size = [], 0
            held.append((path, name, 0, -1))
            size += length
        return [*out, Piece(held)] if held else out

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        """Batches of rows; Spark asks with None where nothing was planned."""
        if piece is None:
            return
        system, _ = _filesystem(self.path)
        form, kinds = FORMATS[self.feed], _arrow(self.schema)
        rows = self._rows(system, form, piece)
        while own := list(islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in own], f.type) for f in kinds], schema=kinds)

    def _rows(self, system, form: Format, piece: Piece) -> Iterator[Row]:
        for path, name, start, end in piece.parts:
            month, parse = month_of(name), form.rows
            if form.document:
                with system.open_input_stream(path) as file:
                    found = parse(file.read().decode("utf-8", "replace"))
            else:
                found = (hourly_block if parse is hourly_lines and name.endswith((".html", ".htm")) else parse)(_lines(system, path, start, end), month)
            for row in found:
                if self.bounds.hold(row[self.time]):
                    row.setdefault("source_type", self.source_type)
                    yield row


class LandedReader(_Files, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on the feed's time are kept by the reader; all other filters stay with Spark."""
        for f in filters:
            own = getattr(f, "attribute", None) == (self.time,)
            value = getattr(f, "value", None)
            if own and isinstance(f, IsNotNull):
                continue
            if not own or not isinstance(value, datetime) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            at = value if value.tzinfo else value.replace(tzinfo=UTC)
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.bounds.above(at, not isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.bounds.below(at, not isinstance(f, LessThan))

    def partitions(self) -> list[Piece]:
        return self.plan(_listed(self.path))


class LandedStream(_Files, DataSourceStreamReader):
    """Files in the order of their times; the offset names the last one taken."""

    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.settle = float(options.get("settleseconds", 0))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        ready = int((datetime.now(UTC).timestamp() - self.settle) * 1e9)
        files = [f for f in _listed(self.path) if f[0] <= ready]
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        after, last = (start["time"], start["path"]), (end["time"], end["path"])
        return self.plan([f for f in _listed(self.path) if after < f[:2] <= last])

    def commit(self, end: dict) -> None:
        """Landed files stay; retention is another job's business."""


class Landed(DataSource):
    """Options: `feed` (a name in FEEDS), `path`, and optional `splitBytes`, `sourceType`, `settleSeconds`."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def _options(self) -> dict:
        given = {k.lower(): v for k, v in self.options.items()}
        if given.get("feed") not in FORMATS:
            raise ValueError(f"option feed must be one of {', '.join(sorted(FORMATS))}")
        if "path" not in given:
            raise ValueError("a folder to load is needed")
        return given

    def schema(self) -> StructType:
        from stormline.sources.feeds import FEEDS

        return FEEDS[self._options()["feed"]].schema

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(schema, self._options())

    def streamReader(self, schema: StructType) -> LandedStream:
        return LandedStream(schema, self._options())


def _arrow(schema: StructType) -> pa.Schema:
    kinds = {"timestamp": pa.timestamp("us", "UTC"), "double": pa.float64(), "string": pa.string(), "date": pa.date32()}
    return pa.schema([(f.name, kinds[f.dataType.typeName()]) for f in schema.fields])


def _series(*names: str, times: tuple[str, ...] = ("time_tag", "time", "datetime"), **renamed: str) -> Format:
    return Format(lambda text: json_series(text, times, {n: n for n in names} | renamed), cut=False, document=True)


FORMATS: dict[str, Format] = {
    "dst": Format(hourly_lines, by_month=True),
    "cme": Format(catalogue, cut=False),
    "radio_flux": Format(flux_table),
    "flares_realtime": Format(flare_lines),
    "flares_archive": Format(flare_lines),
    "kp_index": _series(kp="kp_index"),
    "sunspot_number": _series("sunspot_number", ssn="sunspot_number"),
    "imf_a": _series("bx_gsm", "by_gsm", "bz_gsm", "bt"),
    "imf_b": _series("bt", bx_gsm="bx", by_gsm="by", bz_gsm="bz"),
    "plasma_a": _series("density", "speed", "temperature"),
    "plasma_b": _series("density", "speed", "temperature"),
    "xray_flux": _series("irradiance_xrsa1", "irradiance_xrsa2", "irradiance_xrsb1", "irradiance_xrsb2", "xrs_ratio"),
}


def register(spark: SparkSession) -> None:
    """Make `format("landed")` known to the session; bounds on times are pushed into it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Landed)
