"""The data sets handed to the dashboard, built from the forecasting outputs in one place.

* ``top_features`` — top ``k`` features per target by split count (ties by name);
* ``error_history`` — per-iteration error of each model and target, long form;
* ``series`` — actual vs forecast per model for each trailing window (1w … 1y), long form;
* ``weather_daily`` — a weather metric per city and day.

``write_handover`` writes each as JSON lines under one folder, one sub-folder per table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.operators.report import TRAILING_PERIODS, entity_daily_metric, top_k_per_group, trailing_periods
from wattframe.sources.files import write_json


def dashboard_tables(importances: DataFrame | None = None, histories: DataFrame | None = None,
                     predictions: DataFrame | None = None, ts_col: str = "ts", series_cols: list[str] | None = None,
                     weather: DataFrame | None = None, weather_ts: str = "dt", city_col: str = "city_name",
                     weather_metric: str = "temp", k: int = 10, periods: dict = TRAILING_PERIODS) -> dict:
    """Any subset of the inputs may be given; the matching tables are returned (lazy DataFrames).

    ``importances``: (target, feature, split_count); ``histories``: (model, target, round, metric,
    value); ``predictions``: one row per time with actual / forecast columns ``series_cols``.
    """
    out: dict[str, DataFrame] = {}
    if importances is not None:
        out["top_features"] = top_k_per_group(importances, ["target"], "split_count", k, tie=["feature"])
    if histories is not None:
        out["error_history"] = histories.select("model", "target", "round", "metric", "value")
    if predictions is not None:
        cols = series_cols or [c for c, t in predictions.dtypes if c != ts_col and t == "double"]
        tagged = trailing_periods(predictions.select(ts_col, *cols), ts_col, periods)
        out["series"] = tagged.unpivot(["period", ts_col], cols, "series", "value")
    if weather is not None:
        out["weather_daily"] = entity_daily_metric(weather, weather_ts, city_col, weather_metric)
    return out


def write_handover(tables: dict, folder: str) -> dict:
    """JSON lines per table under ``folder`` (the hand-over format); returns name → path."""
    return {name: write_json(df, f"{folder.rstrip('/')}/{name}", mode="overwrite") for name, df in tables.items()}


__all__ = ["dashboard_tables", "write_handover"]
