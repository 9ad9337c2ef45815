"""Registration of queries and the SQL fixture views their texts build on."""

from __future__ import annotations

import functools
import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stormline.session import prepare, to_naive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

GAP = "WHEN i % 24 IN (5, 6) OR i % 100 BETWEEN 40 AND 46 OR i BETWEEN 300 AND 315 THEN NULL"

# view -> (views it needs, text)
VIEWS: dict[str, tuple[list[str], str]] = {
    "H": ([], "SELECT event_type AS k, date_trunc('hour', ts) AS ts, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2"),
    "HB": (["H"], "SELECT k, min(ts) AS lo, max(ts) AS hi FROM H GROUP BY k"),
    "HG": (["HB"], "SELECT k, lo, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM HB"),
    "GI": (["HG"], "SELECT k, ts, date_diff('hour', lo, ts) AS i FROM HG"),
    "G": (["GI", "H"], f"SELECT GI.k, GI.ts, GI.i, CASE {GAP} ELSE H.v END AS v FROM GI LEFT JOIN H ON H.k = GI.k AND H.ts = GI.ts"),
    "WIDE0": (
        ["H"],
        "SELECT ts, max(v) FILTER (k = 'click') AS click, max(v) FILTER (k = 'error') AS error, "
        "max(v) FILTER (k = 'purchase') AS purchase, max(v) FILTER (k = 'signup') AS signup, "
        "max(v) FILTER (k = 'view') AS view FROM H GROUP BY ts",
    ),
    "WIDE": (
        ["WIDE0"],
        "SELECT *, click - 50 AS by, error - 50 AS bz, signup - 50 AS bx, 300 + 5 * view AS speed, purchase / 10 AS density, "
        "sqrt((signup - 50) * (signup - 50) + (click - 50) * (click - 50) + (error - 50) * (error - 50)) AS bt FROM WIDE0",
    ),
    "DST": (["WIDE"], "SELECT ts, 60 - 2 * error AS dst FROM WIDE WHERE error IS NOT NULL"),
    "KP": (["WIDE"], "SELECT ts, round(least(9, view / 10) * 3) / 3 AS kp FROM WIDE WHERE view IS NOT NULL"),
    "CAT": (
        [],
        "SELECT event_id, ts, 200 + 10 * value AS median_velocity, 3.6 * CAST(props->>'k' AS DOUBLE) AS angular_width, "
        "CAST((event_id * 37) % 360 AS DOUBLE) AS position_angle, value AS velocity_variation FROM events WHERE event_type = 'purchase'",
    ),
    "DAY": ([], "SELECT o_orderdate AS ts, avg(o_totalprice) / 100 AS v FROM orders GROUP BY 1"),
    "FEED_A": (["G"], "SELECT ts, v FROM G WHERE k = 'click'"),
    "FEED_B": (["G"], "SELECT ts, v FROM G WHERE k = 'view'"),
    "PROB": (
        [],
        "SELECT d.doc_id, l.quality AS y, (d.n_chars % 997 + 1) / 999.0::DOUBLE AS p FROM documents d JOIN labels l ON l.doc_id = d.doc_id",
    ),
}


def sql(body: str, *views: str, **more: str) -> str:
    """The body behind the WITH list of the named views (and of those they need), then of `more`."""
    order: list[str] = []

    def need(view: str) -> None:
        for other in VIEWS[view][0]:
            need(other)
        if view not in order:
            order.append(view)

    for view in views:
        need(view)
    parts = [f"{v} AS ({VIEWS[v][1]})" for v in order] + [f"{n} AS ({t})" for n, t in more.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + textwrap.dedent(body).strip()


def r6(expression: str) -> str:
    """Six decimals; the offset keeps exact ties (means of cents) off the edge, where the last bit would decide."""
    return f"(round({expression} + 3.7e-10, 6) + 0.0)"


def r3(expression: str) -> str:
    """Three decimals, for figures in the ten thousands."""
    return f"(round({expression} + 3.7e-7, 3) + 0.0)"


def query(name: str, text: str | None = None):
    """Register a query; instants leave as zone-free timestamps."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return to_naive(fn(prepare(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if text is not None:
            SQL[name] = text
        return run

    return wrap
