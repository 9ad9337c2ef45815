"""Quality of probabilities, and the portable calibrator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormline.operators.chunks import CHUNK, HALO, before, chunk_window, over_chunks, upto, with_context, with_value_bin

EPS = 1e-15


def log_loss(y: str, p: str) -> Column:
    clipped = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(p)))
    return F.avg(-F.when(F.col(y) == 1, F.log(clipped)).otherwise(F.log(1 - clipped)))


def prob_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), log_loss(y, p).alias("log_loss"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier")
    )


def pr_curve(df: DataFrame, y: str, p: str, by: Sequence[str] = (), bins: int = 128) -> DataFrame:
    """Precision and recall at every distinct score, from the highest down.

    Equal scores are summed first; the running counts go over bins of about equally many distinct scores, so no group
    of scores is ranked in one task, however close together the scores lie.
    """
    scores = df.groupBy(*by, F.col(p).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    rows = with_value_bin(scores, "threshold", bins).withColumn(CHUNK, -F.col(CHUNK))
    totals = rows.groupBy(*by, CHUNK).agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    ahead = before(over_chunks(by))
    context = totals.select(
        *by, CHUNK,
        *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0).cast("long")).alias(c) for c in ("n", "pos")],
        F.sum("_pos").over(Window.partitionBy(*by)).alias("_all"),
    )
    run = upto(chunk_window(by, F.col("threshold").desc()))
    counted = with_context(rows, context).select(
        "*", F.sum("n").over(run).alias("_seen"), F.sum("pos").over(run).alias("_hit"), F.first("_all", ignorenulls=True).over(run).alias("_total")
    )
    kept = counted.filter(~F.col(HALO))
    return kept.select(
        *by, "threshold", (F.col("_hit") / F.col("_seen")).alias("precision"),
        F.when(F.col("_total") > 0, F.col("_hit") / F.col("_total")).alias("recall"),
        F.when(F.col("_total") > 0, F.col("pos") / F.col("_total")).alias("recall_step"),
    )


def average_precision(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Step-wise area: each score's gain in recall times the precision there."""
    curve = pr_curve(df, y, p, by)
    return curve.groupBy(*by).agg(F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision"))


def fit_isotonic(df: DataFrame, y: str, p: str) -> tuple[list[float], list[float]]:
    """Thresholds of a monotone calibration.  Equal scores are merged to one weighted point before the fit."""
    points = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("x")).agg(
        F.avg(F.col(y).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w")
    )
    model = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(points)
    return [float(v) for v in model.boundaries], [float(v) for v in model.predictions]


def calibrate(p: Column, x: Sequence[float], y: Sequence[float]) -> Column:
    """Linear interpolation between thresholds, held flat outside; no thresholds leave p as it is."""
    if not x or len(x) != len(y):
        return p
    xs, ys = F.array(*[F.lit(float(v)) for v in x]), F.array(*[F.lit(float(v)) for v in y])
    at = F.size(F.filter(xs, lambda b: b <= p)) - 1
    x0, x1, y0, y1 = F.get(xs, at), F.get(xs, at + 1), F.get(ys, at), F.get(ys, at + 1)
    inside = y0 + (y1 - y0) * (p - x0) / (x1 - x0)
    return F.when(p.isNull(), None).when(at < 0, float(y[0])).when(at >= len(x) - 1, float(y[-1])).otherwise(inside)
