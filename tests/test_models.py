"""Model-backed operators: importance against the debug tree, forecasts against the mean predictor."""

import datetime as dt
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from wattframe.operators.features import stable_layout
from wattframe.plans import forecast as FC


def _series(spark, n=24 * 60):
    t0 = dt.datetime(2016, 1, 1)
    rows = []
    for i in range(n):
        t = t0 + dt.timedelta(hours=i)
        a, b = math.sin(i / 7.0), (i % 24) / 24.0
        rows.append((t, a, b, float(i % 5), 10 * a + 5 * b + 0.1 * ((i * 7919) % 13)))
    return spark.createDataFrame(rows, "ts timestamp_ntz, a double, b double, c double, y double")


def test_split_counts_match_debug_tree(spark):
    df = _series(spark)
    params = {"learning_rate": 0.1, "max_depth": 3, "n_estimators": 5}
    imp = {r["feature"]: r["split_count"] for r in FC.split_importance(df, "ts", "y", params, rounds=5).collect()}
    cols = FC.feature_columns(df, "y", "ts")
    model = FC.gbt("y", **dict(params, n_estimators=5)).fit(FC._assembler(cols).transform(stable_layout(df, ["ts"])))
    debug = Counter(int(m) for m in re.findall(r"If \(feature (\d+) ", model.toDebugString))
    assert {c: imp[c] for c in cols} == {c: debug.get(i, 0) for i, c in enumerate(cols)}


def test_trees_beat_mean_predictor(spark):
    df = _series(spark, 24 * 800)  # spans 2016-2018
    pred = FC.forecast_trees(df, "ts", "y", 2018, {"learning_rate": 0.1, "max_depth": 4, "n_estimators": 20})
    r = pred.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("y_predicted"), 2))).alias("rmse"),
                 F.stddev_pop("y").alias("sd")).first()
    assert pred.count() > 0 and r["rmse"] < 0.5 * r["sd"]


def test_history_forecaster_beats_mean(spark):
    df = _series(spark, 24 * 90)
    pred, errors, history = FC.forecast_from_history(df, "ts", "y", ["2016-02-15", "2016-03-10"], history=24)
    r = pred.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("y_predicted"), 2))).alias("rmse"),
                 F.stddev_pop("y").alias("sd")).first()
    assert r["rmse"] < r["sd"]
    assert {e["split"] for e in errors.collect()} == {"train", "validation"}
    assert history.count() > 0


def test_history_forecaster_trees_keep_best_round(spark):
    df = _series(spark, 24 * 90)
    pred, errors, history = FC.forecast_from_history(df, "ts", "y", ["2016-02-15", "2016-03-10"], history=24,
                                                     model="gbt", max_iter=15, patience=3)
    assert pred.count() > 0
    val = sorted((r["iteration"], r["value"]) for r in history.filter("split = 'validation'").collect())
    # the kept model's last round is its best validation round
    assert min(v for _, v in val) == val[-1][1]
