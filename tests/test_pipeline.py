"""End-to-end invariants of the resolution pipeline and the history windows."""

from pyspark.sql import functions as F

from wattframe.operators import report, sequences
from wattframe.plans import weather as WE


def _weather(spark):
    rows = []
    rid = 0
    for h in range(40):
        for city in ("A", "B"):
            copies = 2 if h % 7 == 0 else 1
            for c in range(copies):
                temp = float((h * 3 + c * 11) % 17)
                cls = "rain" if temp < 8 else "clear"
                rows.append((rid, f"h{h:02d}", city, temp, float(h % 5), cls, 500.0 + c if cls == "rain" else 800.0 + c))
                rid += 1
    return spark.createDataFrame(rows, "rid long, hour string, city string, temp double, hum double, cls string, wid double")


def test_resolve_never_invents_rows(spark):
    df = _weather(spark)
    sel, merged = WE.resolve_duplicates(df, "hour", "city", ["A", "B"], ["temp", "hum"], "cls", "wid",
                                        {"rain": 500, "clear": 800}, "rid", cap=50)
    orig_ids = {r.rid for r in df.select("rid").collect()}
    merged_ids = [r.rid for r in merged.select("rid").collect()]
    assert set(merged_ids) <= orig_ids and len(merged_ids) == len(set(merged_ids))
    # every unique (hour, city) survives untouched
    unique = df.groupBy("hour", "city").count().filter("count = 1").count()
    assert merged.join(df.groupBy("hour", "city").count().filter("count = 1"), ["hour", "city"]).count() == unique
    # repeated (hour, city) keep exactly the rows the selector flagged
    flagged = {r.rid for r in sel.filter("select_flag = 1").collect()}
    assert flagged <= set(merged_ids)


def test_multi_step_labels(spark):
    df = spark.createDataFrame([(i, float(i), float(10 * i)) for i in range(30)], "idx long, x double, y double")
    out = {r["idx"]: r["label"] for r in sequences.build_sequences(df, "idx", "x", "y", history=24, horizon=3).collect()}
    assert sorted(out) == list(range(24, 28))
    assert out[24] == [240.0, 250.0, 260.0]


def test_history_long(spark):
    curve = spark.createDataFrame([(0, 2.0, 3.0), (1, 1.0, 2.5)], "round int, train_rmse_mean double, test_rmse_mean double")
    long = report.history_long(curve, "trees")
    assert long.count() == 4 and set(long.columns) == {"model", "round", "metric", "value"}
    assert long.filter((F.col("round") == 1) & (F.col("metric") == "test_rmse_mean")).first()["value"] == 2.5


def test_resolve_exact_copies_keep_one(spark):
    rows = [(1, "h1", "A", 3.0, 1.0, "rain", 500.0), (1, "h1", "A", 3.0, 1.0, "rain", 500.0),
            (2, "h2", "A", 20.0, 2.0, "clear", 800.0), (3, "h3", "A", 4.0, 1.0, "rain", 500.0),
            (4, "h4", "A", 21.0, 3.0, "clear", 800.0)]
    df = spark.createDataFrame(rows, "rid long, hour string, city string, temp double, hum double, cls string, wid double")
    _, merged = WE.resolve_duplicates(df, "hour", "city", ["A"], ["temp", "hum"], "cls", "wid",
                                      {"rain": 500, "clear": 800}, "rid", cap=10)
    got = sorted((r.hour, r.rid) for r in merged.collect())
    assert got == [("h1", 1), ("h2", 2), ("h3", 3), ("h4", 4)]


def test_resolve_counts_copies_as_peers(spark):
    """Copies of a clear row and one rain row, all predicted clear: the copies are no single row, rain stays."""
    rows = [(1, "h1", "A", 20.0, 1.0, "clear", 801.0), (1, "h1", "A", 20.0, 1.0, "clear", 801.0), (2, "h1", "A", 20.0, 1.0, "rain", 500.0)]
    rows += [(10 + i, f"c{i}", "A", 20.0, 1.0, "clear", 800.0) for i in range(8)]
    df = spark.createDataFrame(rows, "rid long, hour string, city string, temp double, hum double, cls string, wid double")
    sel, merged = WE.resolve_duplicates(df, "hour", "city", ["A"], ["temp", "hum"], "cls", "wid",
                                        {"rain": 500, "clear": 800}, "rid", cap=10)
    assert sel.count() == 3 and [r.rid for r in merged.filter("hour = 'h1'").collect()] == [2]
