"""Run a catalogue query and its SQL text on the same tables and compare them exactly."""

from __future__ import annotations

import math
from datetime import datetime
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else value)
    if isinstance(value, Decimal):
        return ("d", str(value))
    if isinstance(value, datetime):
        return ("t", value.isoformat())
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return (type(value).__name__, str(value))


def _kind(name: str) -> str:
    name = name.lower()
    same = {"bigint": "int64", "int": "int32", "integer": "int32", "double": "double", "string": "text", "varchar": "text",
            "timestamp_ntz": "timestamp", "boolean": "boolean", "smallint": "int16", "float": "float"}
    return same.get(name, name)


def compare(spark: SparkSession, con, fn, text: str, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    df = fn(spark, sf_dir)
    rel = con.sql(text)
    ours = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    theirs = {n: _kind(str(t)) for n, t in zip(rel.columns, rel.types)}
    if sorted(ours) != sorted(theirs):
        return f"columns {sorted(ours)} != {sorted(theirs)}"
    order = sorted(ours)
    left = sorted((tuple(_cell(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in order]
    right = sorted((tuple(_cell(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    out = []
    if ours != theirs:
        out.append("types " + ", ".join(f"{c}: {ours[c]} != {theirs[c]}" for c in order if ours[c] != theirs[c]))
    if len(left) != len(right):
        out.append(f"rows {len(left)} != {len(right)}")
    if left != right:
        pairs = [(a, b) for a, b in zip(left, right) if a != b][:2]
        out.append(f"values {order}: " + " | ".join(f"{a} != {b}" for a, b in pairs))
    return "; ".join(out) if out else ("" if left else "EMPTY")
