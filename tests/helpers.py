import numpy as np
import pandas as pd

START = pd.Timestamp("2024-01-01")


def random_series(seed: int, n: int = 200, keys=("a", "b"), missing: float = 0.3, irregular: bool = False) -> pd.DataFrame:
    """Keyed hourly rows with missing values; `irregular` drops rows and shifts times off the hour."""
    rng = np.random.default_rng(seed)
    frames = []
    for k in keys:
        ts = START + pd.to_timedelta(np.arange(n), unit="h")
        if irregular:
            keep = rng.random(n) > 0.3
            ts = (ts + pd.to_timedelta(rng.integers(0, 3000, n), unit="s"))[keep]
        v = np.round(rng.normal(0, 50, len(ts)), 2)
        v[rng.random(len(ts)) < missing] = np.nan
        frames.append(pd.DataFrame({"k": k, "ts": ts, "v": v}))
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf: pd.DataFrame):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t == "double"})


def collect(df, *order) -> pd.DataFrame:
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def same(left, right, tolerance=1e-9):
    np.testing.assert_allclose(np.asarray(left, dtype=float), np.asarray(right, dtype=float), rtol=tolerance, atol=tolerance, equal_nan=True)
