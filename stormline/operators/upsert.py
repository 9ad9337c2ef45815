"""Deduplication, upserts and cell updates, as aggregations rather than ranked windows.

Picking one row per key with `max_by` is combined on the map side, so a key with very many copies
is reduced before the shuffle and never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], chosen: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(chosen.alias("_row"))
    return picked.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]) if rest else picked.select(*keys)


def _rest(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.struct(*[c for c in df.columns if c not in keys])


def _rank(order: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _pick(df, keys, F.max_by(_rest(df, keys), _rank(order)))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _pick(df, keys, F.min_by(_rest(df, keys), _rank(order)))


def dedupe_valid(df: DataFrame, keys: Sequence[str], valid: Column, order: Sequence[str | Column]) -> DataFrame:
    """A valid row beats any invalid one; among equals the last in order stays."""
    return _pick(df, keys, F.max_by(_rest(df, keys), _rank([valid.cast("int"), *order])))


def group_last(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Per column the last non-null value, which may come from different rows."""
    rank = _rank(order)
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in cols])


def upsert_replace(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """New rows replace old rows of the same key; within a batch the last in order wins."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return dedupe_last(both, keys, ["_batch", *order]).drop("_batch")


def upsert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """Old rows stay; of several new rows with one key the first in order is added."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return dedupe_first(both, keys, ["_batch", *order]).drop("_batch")


def evolve(old: DataFrame, new: DataFrame, col: str = "source_type", default: str = "archive") -> DataFrame:
    """Union that adds a column the old table lacks and reads its NULLs as the default."""
    return old.unionByName(new, allowMissingColumns=True).withColumn(col, F.coalesce(F.col(col), F.lit(default)))


def overlay(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    *,
    fill_only: bool = False,
    append: bool = False,
    mark: tuple[str, str] | None = None,
) -> DataFrame:
    """Write `right`'s non-null cells over `left` (or only into its gaps) by key.

    Keys are unique on each side.  Rows only in `right` are dropped unless `append`; `mark` names a
    column and the value it takes wherever a right row exists.
    """
    a = left.select(*keys, *[F.col(c) for c in left.columns if c not in keys])
    b = right.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = a.join(b, list(keys), "full" if append else "left")
    first, second = ("{}", "_new_{}") if fill_only else ("_new_{}", "{}")
    out = []
    for c in left.columns:
        value = F.coalesce(F.col(first.format(c)), F.col(second.format(c))) if c in cols else F.col(c)
        if mark and c == mark[0]:
            value = F.when(F.col("_hit"), F.lit(mark[1])).otherwise(F.col(c))
        out.append(value.alias(c))
    return joined.select(*out)


def combine_priority(
    primary: DataFrame, secondary: DataFrame, keys: Sequence[str], cols: Sequence[str], codes: tuple[int, int] = (2, 1)
) -> DataFrame:
    """Union of the times; per column the primary's value, else the secondary's, and who supplied it.

    `{col}_source_id` holds the first code for the primary, the second for the secondary, else 0.
    One aggregation over both sides replaces the full outer join; keys are unique on each side.
    """
    def tagged(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*keys, *[(F.col(c) if c in df.columns else F.lit(None).cast("double")).alias(f"_{prefix}_{c}") for c in cols])

    both = tagged(primary, "p").unionByName(tagged(secondary, "s"), allowMissingColumns=True)
    merged = both.groupBy(*keys).agg(*[F.max(f"_{p}_{c}").alias(f"_{p}_{c}") for c in cols for p in "ps"])
    source = {
        c: F.when(F.col(f"_p_{c}").isNotNull(), codes[0]).when(F.col(f"_s_{c}").isNotNull(), codes[1]).otherwise(0).cast("long")
        for c in cols
    }
    return merged.select(
        *keys,
        *[F.coalesce(f"_p_{c}", f"_s_{c}").alias(c) for c in cols],
        *[source[c].alias(f"{c}_source_id") for c in cols],
    )


def dual_channel(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Full outer join of two channels as `{col}1`, `{col}2` and their ratio (NULL over zero)."""
    a = primary.select(*keys, F.col(col).alias(f"{col}1"))
    b = secondary.select(*keys, F.col(col).alias(f"{col}2"))
    return a.join(b, list(keys), "full").withColumn("ratio", F.try_divide(F.col(f"{col}1"), F.nullif(F.col(f"{col}2"), F.lit(0.0))))
