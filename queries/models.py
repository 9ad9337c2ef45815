"""Statistics, metrics and model jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormline.operators.events import greedy_spacing, hazard_labels
from stormline.operators import quality as Q
from stormline.operators.quality import temporal_split
from stormline.operators.segments import crossings
from stormline.plans import collinearity as C
from stormline.plans import features as D
from stormline.plans import horizons as M
from stormline.plans import metrics as P
from stormline.plans import stages as S
from stormline.session import materialise, shared_folder
from stormline.sources.feeds import write_report

from .fixtures import catalogue, dst, keyed, r6, rounded, scored, wide
from .registry import query
from .registry import r6 as s6
from .registry import sql
from .rows import WINDOWS

COLS = ["click", "error", "purchase", "signup", "view", "bz", "bx", "speed", "density", "bt"]
BASE = ["click", "error", "bt"]
_COMPLETE = "SELECT * FROM WIDE WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in COLS)


@query("standardize", sql(
    "SELECT ts, " + ", ".join(s6(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()") + f" AS {c}" for c in COLS) + " FROM W", "WIDE", W=_COMPLETE))
def standardize(spark, sf_dir):
    return rounded(C.standardise(wide(spark, sf_dir).select("ts", *COLS).dropna("any"), COLS).select("ts", *COLS), *COLS)


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM W" for i, a in enumerate(COLS) for b in COLS[i + 1:])


@query("corr_pairs", sql(f"SELECT feature_a, feature_b, {s6('r')} AS r, {s6('abs(r)')} AS abs_r FROM Q WHERE abs(r) >= 0.3", "WIDE", W=_COMPLETE, Q=_PAIRS))
def corr_pairs(spark, sf_dir):
    return rounded(C.corr_pairs(wide(spark, sf_dir), COLS, 0.3), "r", "abs_r")


@query("top_pairs", sql(f"SELECT feature_a, feature_b, {s6('abs(r)')} AS abs_r FROM Q WHERE r IS NOT NULL ORDER BY round(abs(r), 6) DESC, feature_a, feature_b LIMIT 5", "WIDE", W=_COMPLETE, Q=_PAIRS))
def top_pairs(spark, sf_dir):
    pairs = rounded(C.corr_pairs(wide(spark, sf_dir), COLS, 0.0), "abs_r")
    return pairs.orderBy(F.desc("abs_r"), "feature_a", "feature_b").limit(5).select("feature_a", "feature_b", "abs_r")


_R3 = "SELECT corr(click, error) AS a, corr(click, bt) AS b, corr(error, bt) AS c FROM W"


@query("vif", sql(
    f"""SELECT feature, {s6('vif')} AS vif, CASE WHEN vif >= 10 THEN 'high' WHEN vif >= 5 THEN 'warn' ELSE 'ok' END AS level FROM (SELECT unnest(['click', 'error', 'bt']) AS feature,
        unnest([(1 - c * c) / d, (1 - b * b) / d, (1 - a * a) / d]) AS vif FROM (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS d FROM R))""", "WIDE", W=_COMPLETE, R=_R3))
def vif(spark, sf_dir):
    return rounded(C.vif(wide(spark, sf_dir).select(*COLS).dropna("any"), BASE), "vif")


_R3D = "SELECT corr(click, bt) AS a, corr(click, error) AS b, corr(bt, error) AS c FROM WIDE WHERE click IS NOT NULL AND bt IS NOT NULL AND error IS NOT NULL"


@query("vif_dependent", sql(
    f"""SELECT feature, {s6('vif')} AS vif, CASE WHEN vif >= 10 THEN 'high' WHEN vif >= 5 THEN 'warn' ELSE 'ok' END AS level FROM (SELECT unnest(['click', 'by', 'bt', 'error']) AS feature,
        unnest(['Infinity'::DOUBLE, 'Infinity'::DOUBLE, (1 - b * b) / d, (1 - a * a) / d]) AS vif FROM (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS d FROM R))""", "WIDE", R=_R3D))
def vif_dependent(spark, sf_dir):
    """by repeats click, so both are inflated without bound."""
    return rounded(C.vif(wide(spark, sf_dir), ["click", "bt", "by", "error"]), "vif")


@query("condition_number", sql(
    f"SELECT {s6('sqrt(n * (1 + abs(r)))')} AS largest, {s6('sqrt((1 + abs(r)) / (1 - abs(r)))')} AS condition_number, 0::BIGINT AS near_degenerate FROM (SELECT corr(click, bt) AS r, count(*) AS n FROM W)", "WIDE", W=_COMPLETE))
def condition_number(spark, sf_dir):
    return rounded(C.condition_number(wide(spark, sf_dir).select(*COLS).dropna("any"), ["click", "bt"]), "largest", "condition_number")


_SEVEN = ["click", "error", "purchase", "view", "bz", "speed", "density"]
_TWINS = " UNION ALL ".join(f"SELECT corr({a}, {b}) AS r FROM W" for i, a in enumerate(_SEVEN) for b in _SEVEN[i + 1:])


@query("near_degenerate", sql("SELECT count(*) AS near_degenerate FROM Q WHERE abs(r) > 1 - 1e-9", "WIDE", W=_COMPLETE, Q=_TWINS))
def near_degenerate(spark, sf_dir):
    """bz, speed and density repeat three other columns, so three singular values vanish."""
    return C.condition_number(wide(spark, sf_dir).select(*COLS).dropna("any"), _SEVEN).select("near_degenerate")


@query("report_files", sql(f"SELECT feature_a, feature_b, {s6('r')} AS r, {s6('abs(r)')} AS abs_r FROM Q WHERE abs(r) >= 0.3", "WIDE", W=_COMPLETE, Q=_PAIRS))
def report_files(spark, sf_dir):
    path = shared_folder(spark)
    pairs = rounded(C.corr_pairs(wide(spark, sf_dir), COLS, 0.3), "r", "abs_r")
    write_report(pairs, path, "json")
    return spark.read.schema(pairs.schema).json(path)


_LOSS = "-CASE WHEN y = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, p))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, p))) END"


@query("prob_metrics", sql(f"SELECT count(*) AS n, {s6(f'avg({_LOSS})')} AS log_loss, {s6('avg((p - y) * (p - y))')} AS brier FROM PROB", "PROB"))
def prob_metrics(spark, sf_dir):
    return rounded(P.prob_metrics(scored(spark, sf_dir), "y", "p"), "log_loss", "brier")


_CURVE = {
    "D": "SELECT p, count(*) AS n, sum(y) AS pos FROM PROB GROUP BY p",
    "V": "SELECT p, pos, sum(n) OVER (ORDER BY p DESC) AS seen, sum(pos) OVER (ORDER BY p DESC) AS hit, sum(pos) OVER () AS total FROM D",
}


@query("pr_curve", sql(f"SELECT {s6('p')} AS threshold, {s6('hit / seen')} AS precision, {s6('hit / total')} AS recall FROM V", "PROB", **_CURVE))
def pr_curve(spark, sf_dir):
    return rounded(P.pr_curve(scored(spark, sf_dir), "y", "p").drop("recall_step"), "threshold", "precision", "recall")


@query("average_precision", sql(f"SELECT {s6('sum(pos / total * hit / seen)')} AS average_precision FROM V", "PROB", **_CURVE))
def average_precision(spark, sf_dir):
    return rounded(P.average_precision(scored(spark, sf_dir), "y", "p"), "average_precision")


_X, _Y = [0.1, 0.25, 0.4, 0.41, 0.8], [0.0, 0.05, 0.05, 0.3, 0.9]
_PIECES = " ".join(f"WHEN p < {b} THEN {c} + ({d} - {c}) * (p - {a}) / ({b} - {a})" for a, b, c, d in zip(_X, _X[1:], _Y, _Y[1:]))


@query("apply_calibrator", sql(f"SELECT doc_id, {s6(f'CASE WHEN p < {_X[0]} THEN {_Y[0]} {_PIECES} ELSE {_Y[-1]} END')} AS p FROM PROB", "PROB"))
def apply_calibrator(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", r6(P.calibrate(F.col("p"), _X, _Y)).alias("p"))


# the fitted value at a point is the largest, over starts at or before it, of the smallest mean up to an end at or after it
_ISO = {
    "D": "SELECT p, sum(y) AS s, count(*) AS n FROM PROB GROUP BY p",
    "R": "SELECT *, row_number() OVER (ORDER BY p) AS i, sum(s) OVER (ORDER BY p) AS cs, sum(n) OVER (ORDER BY p) AS cn FROM D",
    "A": "SELECT a.i AS a, b.i AS i, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM R a JOIN R b ON b.i >= a.i",
    "L": "SELECT a, i, min(m) OVER (PARTITION BY a ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM A",
    "FIT": "SELECT R.p, max(m) AS g FROM L JOIN R ON R.i = L.i GROUP BY R.p",
}


@query("isotonic_calibrate", sql(f"SELECT doc_id, y, {s6('PROB.p')} AS p, {s6('g')} AS p_calibrated FROM PROB JOIN FIT ON FIT.p = PROB.p", "PROB", **_ISO))
def isotonic_calibrate(spark, sf_dir):
    df = scored(spark, sf_dir)
    x, y = P.fit_isotonic(df, "y", "p")
    return df.select("doc_id", "y", r6("p").alias("p"), r6(P.calibrate(F.col("p"), x, y)).alias("p_calibrated"))


HORIZONS = range(1, 9)
FEATURES = ["bz", "bx", "by", "speed", "density", "bt", "newell_dphi_dt", "ey", "dynamic_pressure", "delta_bz", "bz_min_6h", "newell_int_6h", "ey_mean_6h"]


def design(spark, sf_dir):
    """Window features joined with onset labels and split by time."""
    one = {"keys": [], "ts": "ts", "chunk": "5d"}
    repaired = Q.impute_gap_rule(wide(spark, sf_dir).select("ts", "bx", "by", "bz", "bt", "speed", "density"), ["bx", "by", "bz", "bt", "speed", "density"], **one)
    features = D.imf_windows(D.imf_coupling(repaired, **one), **one)
    onsets = greedy_spacing(crossings(dst(spark, sf_dir), "dst", -30.0, **one).select("ts"), keys=[], ts="ts", chunk="5d")
    labels = hazard_labels(features.select("ts"), onsets.select(F.col("ts").alias("o")), keys=[], ts="ts", onset="o")
    return temporal_split(features.join(labels, "ts"), "ts", WINDOWS).select("ts", "split", *FEATURES, *[f"h_{h}" for h in HORIZONS])


def _materialised(spark, sf_dir):
    return materialise(design(spark, sf_dir))


@query("train_horizon")
def train_horizon(spark, sf_dir):
    """A short search: small trials, their numbers given as the parameters that they are."""
    found = M.search(_materialised(spark, sf_dir), FEATURES, "h_1", [M.Trial(2, 4, 0.1), M.Trial(3, 4, 0.3)], lambda best: M.around(best, n=2))
    rows = [(phase, t.depth, t.rounds, t.rate, loss, t == found.trial) for phase, t, loss in found.results]
    return spark.createDataFrame(rows, "phase string, depth int, rounds int, rate double, log_loss double, best boolean")


@query("prune_features")
def prune_features(spark, sf_dir):
    model = M.fit(_materialised(spark, sf_dir), FEATURES, "h_1", M.Trial(3, 4, 0.2))
    kept = set(M.prune(model, FEATURES))
    return spark.createDataFrame([(f, s, f in kept) for f, s in M.gain_shares(model, FEATURES)], "feature string, gain_share double, kept boolean")


def _feeds(spark, sf_dir):
    """The raw feeds that the stages take, from event kinds."""
    raw = keyed(spark, sf_dir).select("k", "event_id", F.col("ts").alias("time_tag"), "v")

    def kind(k, **cols):
        return raw.filter(F.col("k") == k).select("time_tag", *[value.alias(name) for name, value in cols.items()])

    v = F.col("v")
    on_hour = raw.withColumn("time_tag", F.date_trunc("hour", "time_tag")).groupBy("time_tag").agg(F.avg("v").alias("adjusted_flux"))
    cme = catalogue(spark, sf_dir).withColumnRenamed("ts", "time_tag")
    return {
        "dst": kind("error", dst=60 - 2 * v), "kp": kind("view", kp_index=F.least(v / 10, F.lit(9.0))), "sunspot": kind("signup", sunspot_number=v),
        "flux": on_hour, "cme": cme,
        "plasma_a": kind("click", density=v / 10, speed=300 + 5 * v, temperature=v), "plasma_b": kind("view", density=v / 9, speed=310 + 5 * v, temperature=v),
        "field_a": kind("signup", bx_gsm=v - 50, by_gsm=50 - v, bz_gsm=v - 40, bt=v), "field_b": kind("purchase", bx=v - 50, by=50 - v, bz=v - 40, bt=v),
    }


@query("design_matrix")
def design_matrix(spark, sf_dir):
    """All feeds from raw rows to split features, merged with the labels.

    The events span 30 days, so the sunspot windows are given in days of that span; all rows are used.
    """
    plan = S.Plan(WINDOWS, chunk="10d", ssn_rows=(24, 48), ssn_hours=48, ssn_trend_rows=24)
    raw = _feeds(spark, sf_dir)
    features = {
        "dst": S.dst_stage(raw["dst"], plan), "kp": S.kp_stage(raw["kp"], plan), "sunspot": S.sunspot_stage(raw["sunspot"], plan),
        "radio_flux": S.flux_stage(raw["flux"], plan), "cme": S.cme_stage(raw["cme"], plan),
        "imf_solar_wind": S.field_stage(raw["plasma_a"], raw["plasma_b"], raw["field_a"], raw["field_b"], plan),
    }
    return S.labelled(S.design_matrix(features, plan), S.label_stage(raw["dst"], raw["kp"], plan), plan)


@query("score_splits")
def score_splits(spark, sf_dir):
    df = _materialised(spark, sf_dir)
    model = M.fit(df, FEATURES, "h_1", M.Trial(3, 4, 0.2))
    return M.score_splits(df, FEATURES, "h_1", model)


@query("forecast_horizons")
def forecast_horizons(spark, sf_dir):
    """All horizons trained, calibrated jointly and combined."""
    df = _materialised(spark, sf_dir)
    parts = [
        M.score_splits(df, FEATURES, f"h_{h}", M.fit(df, FEATURES, f"h_{h}", M.Trial(3, 4, 0.2))).withColumn("h", F.lit(h)) for h in HORIZONS
    ]
    pooled, _ = M.calibrate_jointly(parts)
    return M.combine(pooled.select("ts", "h", F.col("prob_calibrated").alias("p")), HORIZONS)
