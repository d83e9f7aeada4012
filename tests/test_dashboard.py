import datetime as dt

from wattframe.plans.dashboard import dashboard_tables, write_handover
from wattframe.session import scratch_path


def test_dashboard_tables(spark):
    imp = spark.createDataFrame([("price", f"f{i}", i % 7) for i in range(30)], "target string, feature string, split_count long")
    hist = spark.createDataFrame([("trees", "price", 0, "rmse", 2.0)], "model string, target string, round int, metric string, value double")
    t0 = dt.datetime(2018, 12, 31)
    pred = spark.createDataFrame([(t0 - dt.timedelta(days=d), float(d), float(d) + 1) for d in range(400)],
                                 "ts timestamp_ntz, price_actual double, price_predicted double")
    wx = spark.createDataFrame([(t0, "Madrid", 10.0), (t0, "Madrid", 14.0)], "dt timestamp_ntz, city_name string, temp double")
    t = dashboard_tables(imp, hist, pred, weather=wx)
    assert set(t) == {"top_features", "error_history", "series", "weather_daily"}
    assert t["top_features"].count() == 10
    counts = {r["period"]: r["count"] for r in t["series"].groupBy("period").count().collect()}
    assert counts["1w"] == 2 * 7 and counts["1y"] == 2 * 365
    assert t["weather_daily"].first()["avg_temp"] == 12.0
    paths = write_handover(t, scratch_path(spark, "dash"))
    assert spark.read.json(paths["top_features"]).count() == 10
