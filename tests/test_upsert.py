"""Upserts, dedupes, overlays and priority combine."""

from pyspark.sql import functions as F

from stormline.operators import upsert as U


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frames(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "id int, v double")
    new = spark.createDataFrame([(2, 20.0, 1), (2, 21.0, 2), (4, 40.0, 3), (3, None, 4)], "id int, v double, seq int")
    return old, new


def test_replace_ignore_and_idempotence(spark):
    old, new = frames(spark)
    replaced = U.upsert_replace(old, new, ["id"], ["seq"]).select("id", "v")
    assert rows(replaced) == [(1, 1.0), (2, 21.0), (3, None), (4, 40.0)]
    assert rows(U.upsert_replace(replaced, new, ["id"], ["seq"]).select("id", "v")) == rows(replaced)
    ignored = U.upsert_ignore(old, new, ["id"], ["seq"]).select("id", "v")
    assert rows(ignored) == [(1, 1.0), (2, 2.0), (3, None), (4, 40.0)]


def test_dedupes(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None)], "k string, t int, v double")
    assert rows(U.dedupe_first(df, ["k"], ["t"])) == [("a", 1, None), ("b", 1, None)]
    assert rows(U.dedupe_last(df, ["k"], ["t"])) == [("a", 3, None), ("b", 1, None)]
    assert rows(U.dedupe_valid(df, ["k"], F.col("v").isNotNull(), ["t"])) == [("a", 2, 5.0), ("b", 1, None)]
    assert rows(U.group_last(df, ["k"], ["v"], ["t"])) == [("a", 5.0), ("b", None)]


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "k string, t int")
    assert rows(U.dedupe_last(df, ["k"], ["t"])) == [(None, 2)]


def test_overlay(spark):
    left = spark.createDataFrame([(1, 1.0, "archive"), (2, None, "archive")], "id int, v double, source_type string")
    right = spark.createDataFrame([(1, None), (2, 2.0), (3, 3.0)], "id int, v double")
    mark = ("source_type", "realtime")
    assert rows(U.overlay(left, right, ["id"], ["v"], mark=mark)) == [(1, 1.0, "realtime"), (2, 2.0, "realtime")]
    assert rows(U.overlay(left, right, ["id"], ["v"], append=True, mark=mark))[2] == (3, 3.0, "realtime")
    assert rows(U.overlay(left, right, ["id"], ["v"], fill_only=True)) == [(1, 1.0, "archive"), (2, 2.0, "archive")]


def test_combine_priority(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "t int, v double")
    b = spark.createDataFrame([(2, 20.0), (3, 30.0), (4, None)], "t int, v double")
    assert rows(U.combine_priority(a, b, ["t"], ["v"])) == [(1, 1.0, 2), (2, 20.0, 1), (3, 30.0, 1), (4, None, 0)]
    assert rows(U.combine_priority(a, a, ["t"], ["v"]).select("t", "v")) == rows(a)


def test_dual_channel_ratio(spark):
    a = spark.createDataFrame([(1, 6.0), (2, 1.0)], "t int, x double")
    b = spark.createDataFrame([(1, 3.0), (2, 0.0), (3, 9.0)], "t int, x double")
    assert rows(U.dual_channel(a, b, ["t"], "x")) == [(1, 6.0, 3.0, 2.0), (2, 1.0, 0.0, None), (3, None, 9.0, None)]
