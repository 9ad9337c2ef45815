"""Keyed time-series features, labels and forecasts as composable Spark DataFrame operators."""
