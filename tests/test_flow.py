"""The full flow on tiny CSV files with the real schemas: names, order and types of every output."""

import datetime as dt
import os
import random
import tempfile

from pyspark.sql import functions as F

from wattframe.plans.flow import build_tables
from wattframe.schemas import CITIES, ENERGY_MEASURES, WEATHER_MEASURES, energy_weather_schema, wide_weather_schema


def _write(path, header, rows):
    with open(path, "w") as fh:
        fh.write(",".join(f'"{h}"' for h in header) + "\n")
        for r in rows:
            fh.write(",".join("" if v is None else str(v) for v in r) + "\n")


def _hours(n, t0=dt.datetime(2015, 1, 1)):
    return [(t0 + dt.timedelta(hours=i)).strftime("%Y-%m-%d %H:%M:%S") + "+01:00" for i in range(n)]


def test_build_tables_schema_and_counts(spark):
    rnd = random.Random(7)
    hours = _hours(60)
    d = tempfile.mkdtemp(prefix="wf-flow-")
    e_rows = [[h] + [round(rnd.uniform(0, 100), 1) if rnd.random() > 0.05 else None for _ in ENERGY_MEASURES]
              for h in hours]
    _write(os.path.join(d, "energy.csv"), ["time"] + ENERGY_MEASURES, e_rows)
    classes = [("clear", 800, "sky is clear", "01"), ("clouds", 803, "broken clouds", "04n"), ("rain", 500, "light rain", "10d")]
    w_rows = []
    for i, h in enumerate(hours):
        for city in CITIES:
            copies = 2 if (i % 11 == 0) else 1
            for c in range(copies):
                cls = classes[(i + c + len(city)) % 3]
                meas = [round(rnd.uniform(0, 30), 2) for _ in range(11)]
                w_rows.append([h, " " + city] + meas + [float(cls[1] + c), cls[0], cls[2], cls[3]])
    _write(os.path.join(d, "weather.csv"), ["dt_iso", "city_name"] + [m for m, _ in WEATHER_MEASURES], w_rows)
    out = build_tables(spark, os.path.join(d, "energy.csv"), os.path.join(d, "weather.csv"),
                       out_dir=os.path.join(d, "out"), expected_hours=60, expected_resolved=30)
    table, wide = out["energy_weather"], out["weather_wide"]
    assert [f.name for f in table.schema] == [f.name for f in energy_weather_schema()]
    assert [f.dataType for f in table.schema] == [f.dataType for f in energy_weather_schema()]
    assert [f.name for f in wide.schema] == [f.name for f in wide_weather_schema()]
    assert table.count() == 60 and wide.count() == 60
    # mean imputation leaves no null in double columns
    doubles = [c for c, t in table.dtypes if t == "double"]
    assert table.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in doubles]) == 1).count() == 0
    # date_time is the UTC instant of the offset text; the month is right
    first = table.orderBy("date_time").first()
    assert first["date_time"] == dt.datetime(2014, 12, 31, 23) and first["date"] == dt.date(2014, 12, 31)
    checks = {r["check"]: r for r in out["checks"]["expectations"].collect()}
    assert set(checks) == {"joined_complete_rows", "wide_complete_rows", "resolved_complete_rows"}
    resolved = checks["resolved_complete_rows"]
    assert resolved["expected"] == 30 and resolved["actual"] == out["predicted"].na.drop().count()
    assert set(out["checks"]["survivors"].columns) == {"dt_iso", "city_name", "n_kept", "n_rows"}
    q = out["checks"]["weather"].first()
    assert q["n_keys"] == 60 and q["n_duplicated_keys"] == 6
    assert spark.read.parquet(os.path.join(d, "out", "energy_weather")).count() == 60


def test_flow_to_forecast_comparison(spark):
    """The README example, end to end, on files that span a year boundary."""
    from wattframe.operators.features import model_input, set_aside
    from wattframe.plans import forecast as FC
    from wattframe.schemas import FORECAST_TARGETS, SET_ASIDE
    rnd = random.Random(3)
    hours = _hours(24 * 20, dt.datetime(2017, 12, 22))
    d = tempfile.mkdtemp(prefix="wf-flow2-")
    _write(os.path.join(d, "energy.csv"), ["time"] + ENERGY_MEASURES,
           [[h] + [round(rnd.uniform(0, 100), 1) for _ in ENERGY_MEASURES] for h in hours])
    w_rows = [[h, city] + [round(rnd.uniform(0, 30), 2) for _ in range(11)] + [800.0, "clear", "sky is clear", "01d"]
              for h in hours for city in CITIES]
    _write(os.path.join(d, "weather.csv"), ["dt_iso", "city_name"] + [m for m, _ in WEATHER_MEASURES], w_rows)
    out = build_tables(spark, os.path.join(d, "energy.csv"), os.path.join(d, "weather.csv"), expected_hours=None)
    table = out["energy_weather"].withColumn("ts", F.col("date_time"))
    small = {t: {"learning_rate": 0.1, "max_depth": 3, "n_estimators": 3} for t in FORECAST_TARGETS}
    preds = FC.forecast_targets(model_input(table, "ts"), "ts", {t: p for t, (p, _) in FORECAST_TARGETS.items()},
                                2018, small, set_aside=set_aside(table, "ts", SET_ASIDE))
    pairs = {("trees", t): (t, p) for t, (p, _) in FORECAST_TARGETS.items()}
    pairs |= {("day_ahead", t): (t, f) for t, (_, f) in FORECAST_TARGETS.items()}
    rmse, mean_std = FC.compare_models(preds, "ts", pairs)
    assert rmse.count() == 8 and all(r["n_pairs"] > 0 for r in rmse.collect())
    assert mean_std.count() == 12
