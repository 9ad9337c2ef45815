"""Trailing windows with coverage guards, by time or by rows.

Time windows are half-open `(t - span, t]`: seven hourly rows never count as six hours.  Row
windows count rows.  An aggregate is NULL until `min_periods` values are in its window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK, HALO, POS, US, Span, micros, positions, span_us, with_halo


def half_coverage(width: int) -> int:
    """The usual guard: half of the window, rounded up, at least one."""
    return max(1, ceil(width * 0.5))


@dataclass(frozen=True)
class Panel:
    """Frames inside one chunk of one series; `order` is microseconds or row positions."""

    by: tuple[str, ...]
    order: str

    @property
    def ordered(self):
        return Window.partitionBy(*self.by).orderBy(self.order)

    def whole(self):
        return Window.partitionBy(*self.by)

    def last(self, width: int):
        return self.ordered.rangeBetween(-(width - 1), 0)

    def around(self, back: int, ahead: int):
        return self.ordered.rangeBetween(-back, ahead)

    def until(self, back: int):
        return self.ordered.rangeBetween(Window.unboundedPreceding, -back)


@dataclass(frozen=True)
class Agg:
    """One output column: how far it looks back (and ahead) and how it is computed from a panel."""

    build: Callable[[Panel, int, int], Column]
    width: int
    ahead: int = 0
    by_rows: bool = False

    def at(self, panel: Panel, unit: int) -> Column:
        return self.build(panel, self.width * unit, self.ahead * unit)


def _window(span: Span | None, rows: int | None) -> dict:
    if (span is None) == (rows is None):
        raise ValueError("give either span= (time) or rows= (row count)")
    return {"width": rows, "by_rows": True} if rows is not None else {"width": span_us(span), "by_rows": False}


def _value(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _guarded(agg: Callable[[Column], Column], col: str | Column, min_periods: int, span, rows) -> Agg:
    value = _value(col)

    def build(panel: Panel, width: int, ahead: int) -> Column:
        over = panel.last(width)
        result = agg(value).over(over)
        if min_periods <= 1:
            return result  # an aggregate over no value is NULL already
        return F.when(F.count(value).over(over) >= min_periods, result)

    return Agg(build, **_window(span, rows))


def mean(col, *, span=None, rows=None, min_periods=1) -> Agg:
    return _guarded(F.avg, col, min_periods, span, rows)


def total(col, *, span=None, rows=None, min_periods=1) -> Agg:
    return _guarded(F.sum, col, min_periods, span, rows)


def lowest(col, *, span=None, rows=None, min_periods=1) -> Agg:
    return _guarded(F.min, col, min_periods, span, rows)


def highest(col, *, span=None, rows=None, min_periods=1) -> Agg:
    return _guarded(F.max, col, min_periods, span, rows)


def std_pop(col, *, span=None, rows=None, min_periods=1) -> Agg:
    return _guarded(F.stddev_pop, col, min_periods, span, rows)


def std_samp(col, *, span=None, rows=None, min_periods=1) -> Agg:
    return _guarded(F.stddev_samp, col, min_periods, span, rows)


def fraction(condition: Column, *, span=None, rows=None, min_periods=1) -> Agg:
    """Share of rows where the condition holds; a comparison with NULL counts as not holding."""
    return _guarded(F.avg, F.coalesce(condition, F.lit(False)).cast("double"), min_periods, span, rows)


def slope(col, *, span=None, rows=None, min_periods=1, strict=False) -> Agg:
    """Least-squares slope per row; missing values are masked, or void the window when `strict`."""
    value = _value(col)

    def build(panel: Panel, width: int, ahead: int) -> Column:
        over = panel.last(width)
        need = F.count(value).over(over) >= max(min_periods, 2)
        if strict:
            need = need & (F.count(value).over(over) == F.count(F.lit(1)).over(over))
        return F.when(need, F.regr_slope(value, F.col("_x")).over(over))

    return Agg(build, **_window(span, rows))


def since_true(condition: Column, *, span=None, rows=None) -> Agg:
    """Rows since the condition last held inside the window, NULL when it did not."""

    def build(panel: Panel, width: int, ahead: int) -> Column:
        held = F.max(F.when(condition, F.col("_x"))).over(panel.last(width))
        return F.col("_x") - held

    return Agg(build, **_window(span, rows))


def centred_mean(col, *, rows: int, min_periods=1) -> Agg:
    """Mean of an odd number of rows around the current one."""
    value, half = _value(col), rows // 2

    def build(panel: Panel, width: int, ahead: int) -> Column:
        over = panel.around(ahead, ahead)
        return F.when(F.count(value).over(over) >= min_periods, F.avg(value).over(over))

    return Agg(build, width=half + 1, ahead=half, by_rows=True)


def shifted(col, *, rows: int) -> Agg:
    """The value `rows` rows earlier."""
    value = _value(col)

    def build(panel: Panel, width: int, ahead: int) -> Column:
        return F.lag(value, rows).over(panel.ordered)

    return Agg(build, width=rows + 1, by_rows=True)


def wide_mean(col, *, span=None, rows=None, min_periods=1) -> Agg:
    """`mean` for windows of very many rows."""
    return _Wide("mean", _value(col), min_periods, **_window(span, rows))


def wide_std_pop(col, *, span=None, rows=None, min_periods=1) -> Agg:
    return _Wide("std_pop", _value(col), min_periods, **_window(span, rows))


def wide_std_samp(col, *, span=None, rows=None, min_periods=1) -> Agg:
    return _Wide("std_samp", _value(col), min_periods, **_window(span, rows))


def wide_fraction(condition: Column, *, span=None, rows=None, min_periods=1) -> Agg:
    return _Wide("mean", F.coalesce(condition, F.lit(False)).cast("double"), min_periods, **_window(span, rows))


@dataclass(frozen=True)
class _Wide:
    """Wide windows in work linear in the rows, whatever the width.

    Rows are cut into blocks as wide as the window, so a window is the tail of one block and the head of the next.
    Heads and tails are running moments (count, mean, squared deviations) inside their block, and the two are merged;
    nothing is subtracted, so values outside the window leave no trace in the result.
    """

    kind: str
    value: Column
    min_periods: int
    width: int
    by_rows: bool
    ahead: int = 0

    def staged(self, name: str, panel: Panel, unit: int, df: DataFrame) -> tuple[DataFrame, Column]:
        width = self.width * unit
        block, tail, head, total = f"_b_{name}", f"_t_{name}", f"_h_{name}", f"_a_{name}"
        df = df.withColumn(block, F.floor(F.col(panel.order) / F.lit(width)).cast("long"))
        inside = Window.partitionBy(*panel.by, block)

        def moments(over) -> Column:
            n = F.count(self.value).over(over)
            spread = F.lit(0.0) if self.kind == "mean" else F.var_pop(self.value).over(over) * n
            return F.struct(F.col(block).alias("b"), n.alias("n"), F.avg(self.value).over(over).alias("m"), spread.alias("q"))

        rest = inside.orderBy(F.col(panel.order).desc()).rangeBetween(Window.unboundedPreceding, -1)
        df = df.withColumns({
            head: moments(inside.orderBy(panel.order).rangeBetween(Window.unboundedPreceding, 0)), tail: moments(rest), total: moments(inside),
        })
        # the last row that has left the window tells what of its block is still inside; no row of that block has left: all of it is
        left = F.last(tail).over(panel.until(width))
        earlier = Window.partitionBy(*panel.by).orderBy(block).rangeBetween(Window.unboundedPreceding, -1)
        known, whole = f"_l_{name}", f"_w_{name}"
        df = df.withColumns({known: left, whole: F.last(total).over(earlier)})
        before = F.col(block) - 1
        old = F.when(F.col(known)["b"] == before, F.col(known)).when(F.col(whole)["b"] == before, F.col(whole))
        n1, n2 = F.coalesce(old["n"], F.lit(0)), F.col(head)["n"]
        n = n1 + n2
        m1, m2 = F.coalesce(old["m"], F.lit(0.0)), F.coalesce(F.col(head)["m"], F.lit(0.0))
        if self.kind == "mean":
            result = (n1 * m1 + n2 * m2) / F.when(n > 0, n)
        else:
            divisor = n if self.kind == "std_pop" else n - 1
            squares = F.coalesce(old["q"], F.lit(0.0)) + F.coalesce(F.col(head)["q"], F.lit(0.0)) + (m2 - m1) * (m2 - m1) * n1 * n2 / F.when(n > 0, n)
            result = F.sqrt(squares / F.when(divisor > 0, divisor))
        return df, F.when(n >= max(self.min_periods, 1), result)


def rolling(
    df: DataFrame,
    columns: dict[str, Agg],
    *,
    keys: Sequence[str],
    ts: str,
    chunk: Span = "30d",
    step: Span | None = None,
    chunk_rows: int = 100_000,
    between: tuple[str, str] | None = None,
) -> DataFrame:
    """Add one column per aggregate.

    With `between` only rows in that inclusive time range are returned, and only those and the rows
    their windows reach are read: a filter above a window is not pushed below it, so it is put there.

    Row windows need `step` (the rows lie on a regular grid, so rows are times) or are computed on
    row positions in blocks of `chunk_rows`; time windows use chunks of `chunk`.
    """
    if between:
        if step is None and any(a.by_rows for a in columns.values()):
            raise ValueError("row windows without a step reach unknown times; filter the result instead")
        unit = span_us(step) if step else 1
        back = max(a.width * (unit if a.by_rows else 1) for a in columns.values())
        ahead = max(a.ahead * (unit if a.by_rows else 1) for a in columns.values())
        kind = df.schema[ts].dataType
        lo, hi = (F.lit(edge).cast("timestamp") for edge in between)
        reach = (F.timestamp_micros(micros(lo) - F.lit(back)), F.timestamp_micros(micros(hi) + F.lit(ahead)))
        sliced = df.filter((F.col(ts) >= reach[0].cast(kind)) & (F.col(ts) <= reach[1].cast(kind)))
        out = rolling(sliced, columns, keys=keys, ts=ts, chunk=chunk, step=step)
        return out.filter((F.col(ts) >= lo.cast(kind)) & (F.col(ts) <= hi.cast(kind)))
    timed = {n: a for n, a in columns.items() if not a.by_rows}
    counted = {n: a for n, a in columns.items() if a.by_rows}
    if counted and step is None:
        block = max(chunk_rows, 2 * max(a.width + a.ahead for a in counted.values()))
        numbered = positions(df, keys=keys, ts=ts, chunk=chunk)
        df = _apply(numbered, counted, keys, POS, block, unit=1).drop(POS)
        counted = {}
    together = {**timed, **counted}
    if together:
        unit = span_us(step) if step else 1
        df = _apply(df.withColumn(US, micros(ts)), together, keys, US, span_us(chunk), unit=unit)
    return df


def _apply(df, columns, keys, order, width, unit) -> DataFrame:
    reach = {n: (a.width * (unit if a.by_rows else 1), a.ahead * (unit if a.by_rows else 1)) for n, a in columns.items()}
    rows = with_halo(df, order, width, back=max(w for w, _ in reach.values()), ahead=max(a for _, a in reach.values()))
    panel = Panel((*keys, CHUNK), order)
    rows = rows.withColumn("_x", F.row_number().over(panel.ordered).cast("double"))
    plain, outputs = {}, list(columns)
    for name, agg in columns.items():
        scale = unit if agg.by_rows else 1
        if isinstance(agg, _Wide):
            rows, expression = agg.staged(name, panel, scale, rows)
        else:
            expression = agg.at(panel, scale)
        plain[f"_r_{name}"] = expression
    rows = rows.select("*", *[e.alias(n) for n, e in plain.items()])
    kept = [c for c in df.columns if c not in (US, *outputs)]
    return rows.filter(~F.col(HALO)).select(*kept, *[F.col(f"_r_{n}").alias(n) for n in outputs])


__all__ = [
    "Agg", "centred_mean", "fraction", "half_coverage", "highest", "lowest", "mean", "rolling", "shifted",
    "since_true", "slope", "std_pop", "std_samp", "total", "wide_fraction", "wide_mean", "wide_std_pop", "wide_std_samp",
]
