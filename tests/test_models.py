"""Metrics, calibration, collinearity, horizons."""

import numpy as np
import pandas as pd
import pytest
from helpers import collect, same, to_spark
from pyspark.sql import functions as F

from stormline.operators import joins as J
from stormline.plans import collinearity as C
from stormline.plans import horizons as M
from stormline.plans import metrics as P


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(1)
    p = np.round(rng.random(400), 2)
    return pd.DataFrame({"p": p, "y": (rng.random(400) < p**2).astype(int)})


def pool(x, y, w):
    blocks = [[a, a, b * c, c] for a, b, c in zip(x, y, w)]
    i = 0
    while i < len(blocks) - 1:
        if blocks[i][2] / blocks[i][3] > blocks[i + 1][2] / blocks[i + 1][3]:
            nxt = blocks.pop(i + 1)
            blocks[i] = [blocks[i][0], nxt[1], blocks[i][2] + nxt[2], blocks[i][3] + nxt[3]]
            i = max(i - 1, 0)
        else:
            i += 1
    return blocks


def test_isotonic_and_interpolation(spark, scored):
    df = to_spark(spark, scored)
    x, y = P.fit_isotonic(df, "y", "p")
    got = collect(df.select("p", P.calibrate(F.col("p"), x, y).alias("c")), "p")
    same(got["c"], np.interp(got["p"], x, y))
    g = scored.groupby("p")["y"].agg(["mean", "count"]).reset_index()
    fitted = {}
    for lo, hi, s, n in pool(g["p"], g["mean"], g["count"]):
        fitted |= {v: s / n for v in g["p"] if lo <= v <= hi}
    same(got["c"], [fitted[v] for v in got["p"]])
    outside = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "p double").select(P.calibrate(F.col("p"), x, y)).collect()
    assert [r[0] for r in outside] == [y[0], y[-1], None]


@pytest.mark.parametrize("bins", [1, 8, 1024])
def test_precision_recall(spark, scored, bins):
    curve = collect(P.pr_curve(to_spark(spark, scored), "y", "p", bins=bins), "threshold")
    for row in curve.itertuples():
        taken = scored[scored["p"] >= row.threshold]
        assert row.precision == pytest.approx(taken["y"].mean()) and row.recall == pytest.approx(taken["y"].sum() / scored["y"].sum())
    steps = curve.sort_values("threshold", ascending=False)
    area = float((np.diff(steps["recall"], prepend=0) * steps["precision"]).sum())
    assert P.average_precision(to_spark(spark, scored), "y", "p").head()[0] == pytest.approx(area)


def test_loss(spark, scored):
    row = P.prob_metrics(to_spark(spark, scored), "y", "p").head()
    p = scored["p"].clip(1e-15, 1 - 1e-15)
    assert row["log_loss"] == pytest.approx(-(scored["y"] * np.log(p) + (1 - scored["y"]) * np.log(1 - p)).mean())
    assert row["brier"] == pytest.approx(((scored["p"] - scored["y"]) ** 2).mean())


def test_collinearity(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 0] + 0.1 * x[:, 1], "c": x[:, 2]})
    df = to_spark(spark, pdf)
    pairs = C.corr_pairs(df, ["a", "b", "c"], 0.8).collect()
    assert [(r["feature_a"], r["feature_b"]) for r in pairs] == [("a", "b")]
    z = (pdf - pdf.mean()) / pdf.std(ddof=0)
    want = {}
    for c in pdf:
        rest = z.drop(columns=c).to_numpy()
        fit = rest @ np.linalg.lstsq(rest, z[c], rcond=None)[0]
        want[c] = 1 / (1 - 1 + ((z[c] - fit) ** 2).sum() / (z[c] ** 2).sum())
    got = {r["feature"]: r for r in C.vif(df, ["a", "b", "c"]).collect()}
    for c in pdf:
        assert got[c]["vif"] == pytest.approx(want[c], rel=1e-6)
    assert got["a"]["level"] == "high" and got["c"]["level"] == "ok"
    values = [r["singular_value"] for r in C.singular_values(df, ["a", "b", "c"]).orderBy("i").collect()]
    same(values, np.linalg.svd(z.to_numpy(), compute_uv=False), 1e-6)
    twice = df.withColumn("d", F.col("a") * 2)
    assert C.condition_number(twice, ["a", "c", "d"]).head()["near_degenerate"] == 1
    inflated = {r["feature"]: r["vif"] for r in C.vif(twice, ["a", "c", "d"]).collect()}
    assert inflated["a"] == inflated["d"] == float("inf") and inflated["c"] < 2
    back = collect(C.standardise(df, ["a", "b", "c"]), "a")
    same(back["b"], z.sort_values("a")["b"])


def test_horizon_search_prune_and_combination(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"ts": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n), "split": np.where(np.arange(n) < 400, "train", "validation")})
    pdf["h_1"] = (pdf["a"] > 0.5).astype(int)
    df = to_spark(spark, pdf)
    found = M.search(df, ["a", "b"], "h_1", [M.Trial(2, 3, 0.1), M.Trial(2, 3, 0.3)], lambda t: [M.Trial(3, 3, t.rate)])
    model, best, results = found.model, found.trial, found.results
    assert [r[0] for r in results] == ["coarse", "coarse", "fine"] and min(r[2] for r in results) == dict((r[1], r[2]) for r in results)[best]
    pruned = M.search(df, ["a", "b"], "h_1", [M.Trial(2, 3, 0.1)], lambda t: [M.Trial(2, 3, 0.3, 0.9, 0.6, 2, 0.01)], min_share=0.5, at_least=1)
    assert pruned.features == ["a"] and [r[0] for r in pruned.results] == ["coarse", "fine", "fine"]
    assert len(M.coarse_trials()) == 30 and len(M.around(M.coarse_trials()[0])) == 40
    assert M.prune(model, ["a", "b"], min_share=0.5, at_least=1) == ["a"] and M.prune(model, ["a", "b"]) == ["a", "b"]
    scored = M.score_splits(df, ["a", "b"], "h_1", model)
    assert scored.columns == ["ts", "y_true", "y_prob", "split"] and scored.count() == n
    pooled, (x, y) = M.calibrate_jointly([scored])
    assert y == sorted(y) and pooled.filter("prob_calibrated IS NULL").count() == 0


def test_cumulative_probability_and_replacement(spark):
    long = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.1)], "ts int, h int, p double")
    out = {r["ts"]: r for r in M.combine(long, [1, 2]).collect()}
    assert out[1]["p_cumulative"] == 0.75 and out[2]["p_cumulative"] == pytest.approx(0.1) and out[2]["p_h2"] is None
    assert J.pivot_horizons(long, on=["ts"], horizon="h", value="p", horizons=[1, 2], complete=True).count() == 1
    stored = spark.createDataFrame([(1, 0.1), (3, 0.3)], "ts int, p double")
    new = spark.createDataFrame([(1, 0.9)], "ts int, p double")
    assert sorted(map(tuple, M.append_predictions(stored, new).collect())) == [(1, 0.9), (3, 0.3)]
