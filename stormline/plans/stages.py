"""The whole way from raw feeds to a labelled, split design matrix and to forecasts.

Each function is a thin chain of operators.  Frames that several later steps read - the hourly layer
and each feed's features - are written once to the shared folder; everything else stays one plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormline.functions.lookup import kp_to_ap
from stormline.operators import quality as Q
from stormline.operators.chunks import Span
from stormline.operators.events import greedy_spacing, hazard_labels, storm_onsets
from stormline.operators.joins import join_labels, merge_bucketed, outer_join_hour, write_bucketed
from stormline.operators.resample import resample_last, resample_mean
from stormline.operators.segments import drop_long_missing
from stormline.operators.sets import latest_n, preferred
from stormline.operators.upsert import combine_priority
from stormline.session import materialise, shared_folder

from . import features as D
from . import horizons as M
from .metrics import calibrate

PLASMA = ("density", "speed", "temperature")
FIELD = ("bx", "by", "bz", "bt")
DETECTORS = {"irradiance_xrsa": ("irradiance_xrsa1", "irradiance_xrsa2"), "irradiance_xrsb": ("irradiance_xrsb1", "irradiance_xrsb2")}


@dataclass(frozen=True)
class Plan:
    """Split windows, series keys, time column and the settings that differ between runs."""

    windows: Q.Windows
    keys: tuple[str, ...] = ()
    ts: str = "time_tag"
    chunk: Span = "90d"
    as_of: str | None = None
    skip_splits: bool = False
    field_since: str = "1998-02-05"
    long_gap_rows: int = 12
    ssn_rows: tuple[int, int] = (648, 1944)
    ssn_hours: int = 1944
    ssn_trend_rows: int = 1296
    storm_ap: float = 39.0
    storm_dst: float = -50.0
    tables: str | None = None
    buckets: int | None = None

    @property
    def raw(self) -> dict:
        return {"keys": list(self.keys), "ts": self.ts}

    @property
    def series(self) -> dict:
        return {"keys": list(self.keys), "ts": self.ts, "chunk": self.chunk}

    @property
    def per_split(self) -> dict:
        """Windows restart at split borders."""
        return {"keys": [*self.keys, "split"], "ts": self.ts, "chunk": self.chunk}

    @property
    def on(self) -> list[str]:
        return [*self.keys, "split", self.ts]

    def split(self, df: DataFrame) -> DataFrame:
        return Q.temporal_split(df, self.ts, self.windows, skip=self.skip_splits)


def hourly_held(raw: DataFrame, col: str, plan: Plan) -> DataFrame:
    return resample_last(raw, [col], **plan.series)


def dst_stage(raw: DataFrame, plan: Plan) -> DataFrame:
    """Hours without a value are dropped, so nothing is left to impute and row lags span them."""
    hourly = hourly_held(raw, "dst", plan).dropna(subset=["dst"])
    return D.dst_features(plan.split(hourly), **plan.per_split)


def kp_stage(raw: DataFrame, plan: Plan) -> DataFrame:
    hourly = hourly_held(raw, "kp_index", plan)
    return D.kp_features(plan.split(hourly), **plan.per_split, col="kp_index")


def sunspot_stage(raw: DataFrame, plan: Plan) -> DataFrame:
    hourly = plan.split(hourly_held(raw, "sunspot_number", plan))
    lag, mean = plan.ssn_rows
    base = D.ssn_features(hourly, **plan.per_split, step="1h", col="sunspot_number", trend_rows=lag, mean_rows=mean)
    return D.ssn_windows(base, **plan.per_split, step="1h", hours=plan.ssn_hours, trend_rows=plan.ssn_trend_rows)


def flux_stage(raw: DataFrame, plan: Plan) -> DataFrame:
    samples = plan.split(raw.dropna(subset=["adjusted_flux"]))
    return D.flux_windows(D.flux_features(samples, **plan.per_split), **plan.per_split)


def field_stage(plasma_a: DataFrame, plasma_b: DataFrame, field_a: DataFrame, field_b: DataFrame, plan: Plan) -> DataFrame:
    """Two craft, plasma and field: hourly means, craft B before craft A, long gaps dropped, short ones repaired."""
    on = [*plan.keys, plan.ts]
    field_a = field_a.withColumnsRenamed({"bx_gsm": "bx", "by_gsm": "by", "bz_gsm": "bz"})
    plasma = combine_priority(*[resample_mean(df, PLASMA, **plan.raw) for df in (plasma_b, plasma_a)], on, PLASMA)
    field = combine_priority(*[resample_mean(df, FIELD, **plan.raw) for df in (field_b, field_a)], on, FIELD)
    combined = outer_join_hour(plasma, field, on)
    combined = combined.filter(F.col(plan.ts) >= F.lit(plan.field_since).cast(combined.schema[plan.ts].dataType))
    hourly = drop_long_missing(combined, [*PLASMA, *FIELD], plan.long_gap_rows, **plan.series)
    repaired = Q.impute_gap_rule(hourly, [*FIELD, *PLASMA], **plan.series)
    windows = D.imf_windows(D.imf_coupling(plan.split(repaired), **plan.per_split), **plan.per_split)
    return windows.withColumnsRenamed({c: f"{c}_gse" for c in ("bx", "by", "bz")})


def cme_stage(catalogue: DataFrame, plan: Plan) -> DataFrame:
    events = D.cme_event_features(plan.split(catalogue), **plan.per_split)
    return D.cme_windows(D.cme_hourly(events, **plan.per_split, as_of=plan.as_of), **plan.per_split)


def xray_stage(raw: DataFrame, plan: Plan) -> DataFrame:
    """Redundant detectors to one value per channel; missing hours are 0 and flagged before that."""
    detectors = [c for pair in DETECTORS.values() for c in pair]
    hourly = resample_mean(raw, detectors, **plan.raw).withColumn("xrs_missing_flag", Q.all_missing_flag(detectors))
    clean = hourly.withColumns({c: Q.floor_clip(F.col(c)) for c in detectors})
    merged = clean.select(*plan.keys, plan.ts, "xrs_missing_flag", *[F.coalesce(Q.row_median(pair), F.lit(0.0)).alias(c) for c, pair in DETECTORS.items()])
    return D.xray_windows(D.xray_features(plan.split(merged), **plan.per_split), **plan.per_split)


def design_matrix(features: dict[str, DataFrame], plan: Plan) -> DataFrame:
    """Hours that every feed covers, with all feeds' features side by side.

    Each feed's features become a table bucketed and sorted by series, split and time, in the shared folder; with
    `plan.tables` they are named `<tables>_<feed>` and stay for later merges (training, scoring), which read them with
    `merged_tables` and shuffle nothing.
    """
    spark = next(iter(features.values())).sparkSession
    folder = shared_folder(spark)
    names = table_names(features, plan.tables or f"merge_{folder[-32:]}")
    for name, df in features.items():
        write_bucketed(df, names[name], plan.on, plan.buckets, path=f"{folder}/{name}")
    return merge_bucketed(names, plan.on, spark)


def table_names(feeds: Iterable[str], tables: str) -> dict[str, str]:
    return {name: f"{tables}_{name}" for name in feeds}


def merged_tables(spark: SparkSession, feeds: Iterable[str], plan: Plan) -> DataFrame:
    """The merge of tables that `design_matrix` has left under `plan.tables`."""
    return merge_bucketed(table_names(feeds, plan.tables), plan.on, spark)


def label_stage(dst: DataFrame, kp: DataFrame, plan: Plan, horizons: int = 8) -> DataFrame:
    """`h_1..h_n` on the hours that both indices cover, split."""
    ap = hourly_held(kp, "kp_index", plan).select(*plan.keys, plan.ts, kp_to_ap(F.col("kp_index")).alias("ap"))
    index = hourly_held(dst, "dst", plan).join(ap, [*plan.keys, plan.ts])
    storm = (F.col("ap") > plan.storm_ap) & (F.col("dst") < plan.storm_dst)
    onsets = storm_onsets(index, "dst", storm, **plan.series)
    spaced = greedy_spacing(onsets, keys=list(plan.keys), ts="onset", gap="4h", chunk=plan.chunk)
    labels = hazard_labels(index.select(*plan.keys, plan.ts), spaced, **plan.raw, onset="onset", horizons=horizons)
    return plan.split(labels)


def labelled(matrix: DataFrame, labels: DataFrame, plan: Plan) -> DataFrame:
    return join_labels(matrix, labels, keys=[*plan.keys, "split"], ts=plan.ts)


@dataclass(frozen=True)
class Forecaster:
    """Per horizon the selected features and the model, and one calibration for all."""

    features: dict[int, list[str]]
    models: dict[int, object]
    calibration: tuple[list[float], list[float]]


def train(data: DataFrame, horizons: Sequence[int], plan: Plan, coarse: Sequence[M.Trial] | None = None, fine=M.around) -> Forecaster:
    """Search each horizon on the fixed split, prune between the phases, calibrate all jointly.

    The data are written out first: every trial of every horizon reads them. An empty split is an error.
    """
    if not plan.skip_splits:
        Q.require_splits(data, plan.windows)
    data = materialise(data)
    marks = {f"h_{h}" for h in horizons}
    every = [c for c in Q.numeric_columns(data) if c not in marks and c not in plan.on and not c.startswith("h_")]
    features, models, scored = {}, {}, []
    for h in horizons:
        found = M.search(data, every, f"h_{h}", coarse, fine)
        features[h], models[h] = found.features, found.model
        scored.append(M.score_splits(data, features[h], f"h_{h}", models[h], keep=[*plan.keys, plan.ts]))
    _, calibration = M.calibrate_jointly(scored)
    return Forecaster(features, models, calibration)


def forecast(matrix: DataFrame, by: Forecaster, plan: Plan) -> DataFrame:
    """Calibrated probability per horizon and of an onset within all of them."""
    long = None
    for h, model in by.models.items():
        p = M.score(matrix, by.features[h], model).select(
            *plan.keys, plan.ts, F.lit(h).alias("h"), calibrate(F.col("y_prob"), *by.calibration).alias("p")
        )
        long = p if long is None else long.unionByName(p)
    return M.combine(long, list(by.models), on=[*plan.keys, plan.ts])


def forecast_latest(
    matrix: DataFrame, by: Forecaster, plan: Plan, stored: DataFrame | None = None, rows: int = 720, splits: Sequence[str] = ("test", "validation", "train")
) -> DataFrame:
    """Forecast the newest rows of each series; a time that was forecast before replaces its stored row.

    They are taken from one split, the first of `splits` that has rows: with skip_splits each holds every hour.
    """
    chosen = preferred(matrix, "split", splits) if "split" in matrix.columns else matrix
    new = forecast(latest_n(chosen, rows, [plan.ts], plan.keys), by, plan)
    return new if stored is None else M.append_predictions(stored, new, [*plan.keys, plan.ts])
