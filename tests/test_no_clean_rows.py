"""Classifiers of an entity where every key is repeated: no clean row is left to learn from."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as E
from wattframe.operators import profile
from wattframe.plans import weather as WE

INPUTS = ["a", "b"]


def _events(spark, clean=0):
    """Six keys that come twice and ``clean`` keys that come once, all of one entity."""
    t0 = dt.datetime(2024, 1, 1)
    keys = [i for i in range(6) for _ in range(2)] + [10 + i for i in range(clean)]
    rows = [(i, t0 + dt.timedelta(minutes=k), "click", float(i), float(i % 3), "low" if i % 2 else "high") for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "id int, slot timestamp_ntz, entity string, a double, b double, cls string")


def _repeated_keys(df):
    return profile.duplicate_matrix(df, "slot", "entity", ["click"]).select("slot")


def test_metrics_without_a_clean_row(spark):
    df = _events(spark)
    names = ["rf", "dt", "lr", "mlp"]
    preds, metrics, directions = WE.train_and_evaluate_classifier(df, "slot", "entity", "click", INPUTS, "cls", _repeated_keys(df),
                                                                  classifier=names, id_cols=["id"])
    assert list(metrics) == names
    for n in names:
        found = metrics[n].collect()
        assert len({r["metric"] for r in found}) == len(found) == 9
        assert {r["label"] for r in found} == {"ALL"} and {r["value"] for r in found} == {None}
        assert preds[n].count() == directions[n].count() == 0


def test_held_rows_without_a_row_to_fit(spark):
    df = _events(spark, clean=5)
    pred, metrics, direction = WE.train_and_evaluate_classifier(df, "slot", "entity", "click", INPUTS, "cls", _repeated_keys(df),
                                                                id_cols=["id"], fraction=0.0, normalise=True)
    assert pred.count() == 5 and pred.filter("prediction is null and predictedLabel is null and label is null").count() == 5
    assert metrics.filter(F.col("value").isNotNull()).count() == 0 and direction.count() == 0


def test_repeated_rows_without_a_clean_row(spark):
    """Every repeated row comes back, unpredicted, with the columns of a prediction."""
    df, some = _events(spark), _events(spark, clean=8)
    pred = WE.predict_duplicates(df, "slot", "entity", "click", INPUTS, "cls", _repeated_keys(df), id_cols=["id"])
    fitted = WE.predict_duplicates(some, "slot", "entity", "click", INPUTS, "cls", _repeated_keys(some), id_cols=["id"])
    assert [(n, t) for n, t in pred.dtypes] == fitted.dtypes
    assert sorted(r["id"] for r in pred.select("id").collect()) == list(range(12))
    assert pred.filter("prediction is not null or predictedLabel is not null").count() == 0
    assert fitted.filter("prediction is not null and predictedLabel is not null").count() == 12


def test_unlabelled_clean_rows_teach_nothing(spark):
    df = _events(spark, clean=8).withColumn("cls", F.when(F.col("id") < 12, F.col("cls")))
    pred = WE.predict_duplicates(df, "slot", "entity", "click", INPUTS, "cls", _repeated_keys(df), id_cols=["id"])
    assert pred.count() == 12 and pred.filter("prediction is not null or predictedLabel is not null").count() == 0


def test_query_on_events_repeated_with_shifted_ids(spark, tmp_path):
    """The registered query: copies of all events leave no clean row, copies moved in time leave those of each copy."""
    t0, n = dt.datetime(2024, 1, 1), 60
    minutes = [i // 2 if i < 20 else i for i in range(n)]  # ten minutes come twice, the others once
    rows = [(i + n * k, t0 + dt.timedelta(days=k * moved, minutes=m, seconds=i % 60), 7 * i, "view", (13.0 * i) % 100, f'{{"k": {i % 9}}}', moved)
            for moved in (0, 1) for k in range(3) for i, m in enumerate(minutes)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string, moved int")
    for moved, copied, predicted in ((0, range(n), 0), (1, range(20), 3 * 20)):
        events.filter(F.col("moved") == moved).drop("moved").write.parquet(f"{tmp_path}/{moved}/events.parquet")
        got = E.queries()["predict_duplicates"](spark, f"{tmp_path}/{moved}").collect()
        assert sorted(r["event_id"] for r in got) == sorted(i + n * k for k in range(3) for i in copied)
        assert sum(r["prediction"] is not None and r["predictedLabel"] is not None for r in got) == predicted
        assert {r["predictedLabel"] for r in got} <= {"low", "mid", "high", "peak", None}
