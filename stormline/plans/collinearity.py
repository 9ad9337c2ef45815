"""Collinearity of a design matrix.  Rows are reduced to a k x k matrix on the executors; only that
matrix, whose size is the number of features, reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VIF_WARN, VIF_HIGH = 5.0, 10.0


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z-scores with the population deviation; a constant column is 0."""
    stats = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).alias("stats")).scalar()
    return df.withColumns({
        c: F.when(stats[c]["s"] > 0, (F.col(c) - stats[c]["m"]) / stats[c]["s"]).when(F.col(c).isNotNull(), 0.0) for c in cols
    })


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson matrix over the complete rows; all NaN when there are none."""
    complete = df.select(*cols).dropna("any")
    if complete.isEmpty():
        return np.full((len(cols), len(cols)), np.nan)
    vectors = VectorAssembler(inputCols=list(cols), outputCol="x").transform(complete).select("x")
    return Correlation.corr(vectors, "x").head()[0].toArray()


def corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Pairs whose absolute correlation reaches the threshold, strongest first."""
    r = correlation_matrix(df, cols)
    found = [
        (cols[i], cols[j], float(r[i, j]), float(abs(r[i, j])))
        for i in range(len(cols)) for j in range(i + 1, len(cols))
        if abs(r[i, j]) >= threshold
    ]
    pairs = df.sparkSession.createDataFrame(found, "feature_a string, feature_b string, r double, abs_r double")
    return pairs.orderBy(F.desc("abs_r"), "feature_a", "feature_b")


def _triangle(block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block, mode="r")


def standard_factor(df: DataFrame, cols: Sequence[str], groups: int = 32) -> tuple[int, np.ndarray]:
    """Complete rows and the R factor (k x k) of their z-scores, which has the matrix's singular values.

    A tall-skinny QR: every task reduces its rows to one triangle, triangles are stacked and reduced in `groups` groups,
    and only those reach the driver, so small singular values keep their digits.
    """
    k = len(cols)
    rows = standardise(df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna("any"), cols)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = 0, np.zeros((0, k))
        for b in batches:
            n += b.num_rows
            r = _triangle(np.vstack([r, np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])])) if b.num_rows else r
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["n", "r"])

    def stack(table: pa.Table) -> pa.Table:
        r = _triangle(np.vstack([np.frombuffer(x).reshape(-1, k) for x in table["r"].to_pylist()]))
        return pa.table({"n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    parts = rows.select(*cols).mapInArrow(reduce_rows, "n long, r binary").withColumn("g", F.spark_partition_id() % groups)
    found = parts.groupBy("g").applyInArrow(lambda t: stack(t.select(["n", "r"])), "n long, r binary").collect()
    if not found:
        return 0, np.zeros((0, k))
    return sum(x["n"] for x in found), _triangle(np.vstack([np.frombuffer(x["r"]).reshape(-1, k) for x in found]))


def _inflation(n: int, r: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse correlation matrix; infinite for features that others determine to machine precision,
    NaN for constant ones, which no regression explains."""
    k = r.shape[1]
    if not n:
        return np.full(k, np.nan)
    constant = ~r.any(axis=0)
    _, s, v = np.linalg.svd(r)
    s = np.r_[s, np.zeros(k - len(s))]
    null = s <= s.max(initial=0.0) * np.finfo(float).eps * 64 * k
    free = v[null]
    free = free[(free[:, ~constant] ** 2).sum(axis=1) > 1e-8]  # directions of dependence, not of constant columns
    out = n * (v[~null] ** 2 / s[~null, None] ** 2).sum(axis=0)
    return np.where(constant, np.nan, np.where((free**2).sum(axis=0) > 1e-12, np.inf, out))


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation of each feature against all others with a constant, highest first; NULL for a constant one."""
    rows = [(c, None if np.isnan(v) else float(v)) for c, v in zip(cols, _inflation(*standard_factor(df, cols)))]
    out = df.sparkSession.createDataFrame(rows, "feature string, vif double")
    level = F.when(F.col("vif") >= VIF_HIGH, "high").when(F.col("vif") >= VIF_WARN, "warn").otherwise("ok")
    return out.withColumn("level", level).orderBy(F.desc("vif"), "feature")


def singular_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Singular values of the standardised matrix; a constant column is a zero column."""
    n, r = standard_factor(df, cols)
    values = np.r_[np.linalg.svd(r, compute_uv=False), np.zeros(max(0, len(cols) - len(r)))] if n else np.empty(0)
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, singular_value double")


def condition_number(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Condition number and how many singular values are near zero (1e-6 of the largest, at least 1e-12)."""
    s = singular_values(df, cols)
    top, low = F.max("singular_value"), F.min("singular_value")
    tops = s.agg(F.max("singular_value")).scalar()
    near = F.count_if(F.col("singular_value") <= F.greatest(tops * 1e-6, F.lit(1e-12)))
    return s.agg(
        top.alias("largest"), F.when(low > 0, top / low).when(low == 0, float("inf")).alias("condition_number"), near.alias("near_degenerate")
    )
