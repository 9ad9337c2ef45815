"""One classifier per forecast horizon: search on the fixed split, prune, score, calibrate, combine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormline.operators.joins import cumulative_probability, pivot_horizons
from stormline.operators.sets import union_all
from stormline.operators.upsert import upsert_replace

from .metrics import calibrate, fit_isotonic, log_loss

MIN_SHARE = 0.01
MIN_FEATURES = 50


@dataclass(frozen=True)
class Trial:
    """Settings of one boosted-tree model; `columns` is the share of features each split looks at."""

    depth: int
    rounds: int
    rate: float
    rows: float = 0.8
    columns: float = 1.0
    least_child: int = 1
    least_gain: float = 0.0


# Search ranges, the numbers of trials, and how far the fine phase goes around the best coarse trial.
DEPTH, ROUNDS, RATE, SHARE, CHILD, GAIN = (2, 15), (200, 2000), (0.001, 0.2), (0.5, 1.0), (1, 10), (0.0, 5.0)
N_COARSE, N_FINE, AROUND = 30, 40, (0.7, 1.3)


def coarse_trials(n: int = N_COARSE, seed: int = 7) -> tuple[Trial, ...]:
    """Random trials over the whole ranges."""
    rng = np.random.default_rng(seed)
    return tuple(
        Trial(
            int(rng.integers(DEPTH[0], DEPTH[1] + 1)), int(rng.integers(ROUNDS[0], ROUNDS[1] + 1)), float(np.exp(rng.uniform(*np.log(RATE)))),
            float(rng.uniform(*SHARE)), float(rng.uniform(*SHARE)), int(rng.integers(CHILD[0], CHILD[1] + 1)), float(rng.uniform(*GAIN)),
        )
        for _ in range(n)
    )


def around(best: Trial, n: int = N_FINE, seed: int = 8) -> tuple[Trial, ...]:
    """Random trials next to the best coarse one."""
    rng = np.random.default_rng(seed)

    def near(value: float, lo: float, hi: float) -> float:
        return float(min(max(value * rng.uniform(*AROUND), lo), hi))

    return tuple(
        Trial(
            int(min(max(best.depth + rng.integers(-2, 3), DEPTH[0]), DEPTH[1])), max(1, int(best.rounds * rng.uniform(*AROUND))), near(best.rate, *RATE),
            near(best.rows, *SHARE), near(best.columns, *SHARE), max(1, round(near(best.least_child, *CHILD))), near(best.least_gain, *GAIN),
        )
        for _ in range(n)
    )


def vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing features count as 0, as they do when scoring."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df.fillna(0.0, list(features)))


def fit(df: DataFrame, features: Sequence[str], label: str, trial: Trial, seed: int = 7):
    """A boosted-tree model fitted on the complete rows of the train split."""
    booster = GBTClassifier(
        featuresCol="features", labelCol="_y", maxDepth=trial.depth, maxIter=trial.rounds, stepSize=trial.rate, seed=seed, subsamplingRate=trial.rows,
        featureSubsetStrategy="all" if trial.columns >= 1 else str(trial.columns), minInstancesPerNode=trial.least_child, minInfoGain=trial.least_gain,
    )
    train = df.filter(F.col("split") == "train").dropna("any", subset=[*features, label])
    return booster.fit(vectors(train, features).withColumn("_y", F.col(label).cast("double")))


def score(df: DataFrame, features: Sequence[str], model) -> DataFrame:
    """`y_prob` for every row."""
    return model.transform(vectors(df, features)).withColumn("y_prob", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


@dataclass(frozen=True)
class Found:
    """The best model of a search, its trial, the features it uses and all results as (phase, trial, loss)."""

    model: object
    trial: Trial
    features: list[str]
    results: list[tuple[str, Trial, float]]


def search(
    df: DataFrame, features: Sequence[str], label: str, coarse: Sequence[Trial] | None = None, fine=around, min_share: float = MIN_SHARE, at_least: int = MIN_FEATURES
) -> Found:
    """Coarse trials on all features, pruning by the best one's gain, then fine trials on the features that are left.

    Losses are log-losses on the complete rows of the validation split. The caller persists `df`, which every trial reads.
    """
    results: list[tuple[str, Trial, float]] = []
    validation = df.filter(F.col("split") == "validation").dropna("any", subset=[*features, label])

    def best_of(phase: str, trials: Sequence[Trial], cols: list[str]):
        best = None
        for trial in trials:
            model = fit(df, cols, label, trial)
            loss = score(validation, cols, model).agg(log_loss(label, "y_prob")).head()[0]
            results.append((phase, trial, loss))
            if loss is not None and (best is None or loss < best[2]):
                best = (model, trial, loss)
        return best

    cols = list(features)
    first = best_of("coarse", coarse_trials() if coarse is None else coarse, cols)
    if first is None:
        raise ValueError("no trial has a loss: the validation split has no complete row")
    kept = prune(first[0], cols, min_share, at_least)
    trials = list(fine(first[1]))
    if kept != cols:
        trials.insert(0, first[1])  # the best coarse settings are judged on the kept features too
    last = best_of("fine", trials, kept)
    if last is None or (kept == cols and first[2] <= last[2]):
        return Found(first[0], first[1], cols, results)
    return Found(last[0], last[1], kept, results)


def gain_shares(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Each feature's share of the total gain, largest first."""
    gains = model.featureImportances.toArray()
    total = gains.sum() or 1.0
    return sorted(((f, float(g / total)) for f, g in zip(features, gains)), key=lambda e: (-e[1], e[0]))


def prune(model, features: Sequence[str], min_share: float = MIN_SHARE, at_least: int = MIN_FEATURES) -> list[str]:
    """Features with at least `min_share` of the gain, and the next best until `at_least` are kept."""
    ranked = gain_shares(model, features)
    kept = [f for i, (f, share) in enumerate(ranked) if share >= min_share or i < at_least]
    return [f for f in features if f in kept]


def score_splits(df: DataFrame, features: Sequence[str], label: str, model, keep: Sequence[str] = ("ts",)) -> DataFrame:
    return score(df, features, model).select(*keep, F.col(label).alias("y_true"), "y_prob", "split")


def calibrate_jointly(scored: Sequence[DataFrame]) -> tuple[DataFrame, tuple[list[float], list[float]]]:
    """One calibration for all horizons, fitted on their pooled validation rows."""
    pooled = union_all(scored)
    x, y = fit_isotonic(pooled.filter(F.col("split") == "validation"), "y_true", "y_prob")
    return pooled.withColumn("prob_calibrated", calibrate(F.col("y_prob"), x, y)), (x, y)


def combine(long: DataFrame, horizons: Sequence[int], *, on: Sequence[str] = ("ts",)) -> DataFrame:
    """Per time the calibrated probability of each horizon and the probability of an onset in any."""
    wide = pivot_horizons(long, on=on, horizon="h", value="p", horizons=horizons)
    return wide.withColumn("p_cumulative", cumulative_probability([f"p_h{h}" for h in horizons]))


def append_predictions(stored: DataFrame, new: DataFrame, on: Sequence[str] = ("ts",)) -> DataFrame:
    """A time that is predicted again replaces its stored row."""
    return upsert_replace(stored, new, on)


__all__ = [
    "Found", "Trial", "append_predictions", "around", "calibrate_jointly", "coarse_trials", "combine", "fit", "gain_shares", "prune",
    "score", "score_splits", "search", "vectors",
]
