"""Keep / fix decisions of the data model, one test each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.operators import evaluate, features, impute, report, reshape
from wattframe.plans import forecast as FC
from wattframe.session import scratch_path
from wattframe.sources import files as io


def test_all_null_column_raises(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    with pytest.raises(Exception):
        impute.impute_means(df).collect()


def test_fill_zero_leaves_booleans_and_strings(spark):
    df = spark.createDataFrame([(None, None, None)], "x double, b boolean, s string")
    r = impute.fill_zero(df).first()
    assert (r["x"], r["b"], r["s"]) == (0.0, None, None)


def test_fit_scope_guard(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1), 1.0, 2.0)], "ts timestamp_ntz, y double, x double")
    with pytest.raises(ValueError):
        FC._scope(df, "ts", "train", None)
    with pytest.raises(ValueError):
        FC._scope(df, "ts", "everything", 2020)
    assert FC._scope(df, "ts", "train", 2020).count() == 0


def test_csv_schema_renames_by_position(spark):
    df = spark.createDataFrame([(1, "a b", 2.5)], "id long, `generation hydro run-of-river` string, v double")
    path = io.write_csv(df, scratch_path(spark, "t-csv"))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("run_of_river", T.StringType()),
                           T.StructField("value", T.DoubleType())])
    back = io.read_csv(spark, path, schema).first()
    assert back.asDict() == {"key": 1, "run_of_river": "a b", "value": 2.5}


def test_json_handover(spark):
    df = spark.createDataFrame([("temp", 5), ("hum", 0)], "feature string, weight long")
    path = io.write_json(df, scratch_path(spark, "t-json"))
    out = report.flatten_json(spark, path, "feature string, weight long", rename={"weight": "w"},
                              keep=F.col("w") > 0)
    assert out.columns == ["feature", "w"] and [tuple(r) for r in out.collect()] == [("temp", 5)]


def test_wide_missing_entity_is_null(spark):
    df = spark.createDataFrame([("h1", "A", 1.0)], "k string, e string, v double")
    r = reshape.to_wide(df, "k", "e", ["A", "B"], ["v"]).first()
    assert r["v_A"] == 1.0 and r["v_B"] is None


def test_label_index_ties_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "l string")
    m = features.fit_label_index(df, "l")
    assert list(m.labels) == ["c", "a", "b"]


def test_top_k_ties_by_key(spark):
    df = spark.createDataFrame([("g", "x", 3), ("g", "y", 3), ("g", "z", 1)], "g string, f string, s long")
    out = report.top_k_per_group(df, ["g"], "s", 2, tie=["f"])
    assert [r["f"] for r in out.orderBy("rank").collect()] == ["x", "y"]


def test_error_direction_unknown_is_same(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 1.0, "a"), (1.0, None, "b")], "l double, p double, c string")
    out = {(r["pred_label_diff"], r["c"]): r["count"] for r in evaluate.error_direction(df, "l", "p", "c").collect()}
    assert out == {("pos_diff", "a"): 1, ("neg_diff", "a"): 1, ("same", "b"): 1}


def test_trailing_period(spark):
    base = dt.datetime(2020, 1, 31)
    df = spark.createDataFrame([(base - dt.timedelta(days=d),) for d in range(10)], "ts timestamp_ntz")
    assert report.trailing_period(df, "ts", "7 days").count() == 7


def test_year_partitioned_output_prunes(spark):
    df = spark.createDataFrame([(2017, 1.0), (2018, 2.0)], "year int, v double")
    path = io.write_parquet(df, scratch_path(spark, "t-part"), partition_by=["year"])
    q = spark.read.parquet(path).filter(F.col("year") == 2018)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and q.count() == 1


def test_stable_layout_is_layout_independent(spark):
    """The same rows land in the same partitions in the same order, at every size."""
    for n in (1000, 200_001):
        df = spark.range(0, n).select((F.col("id") * 7919 % n).alias("k"))
        placed = [features.stable_layout(df.repartition(p), ["k"]).select(F.spark_partition_id().alias("p"), "k").collect() for p in (3, 7)]
        assert placed[0] == placed[1] and len({r.p for r in placed[0]}) == features.FIT_PARTITIONS


def test_single_file_csv_sink(spark):
    import glob
    from wattframe.session import local_path
    df = spark.range(0, 100).repartition(5)
    path = io.write_csv(df, scratch_path(spark, "t-single"), single_file=True)
    parts = glob.glob(local_path(path) + "/part-*")
    assert len(parts) == 1
    with pytest.raises(Exception):
        io.write_csv(df, path)  # fail if exists (default mode)


def test_merge_null_keys_group_like_group_by(spark):
    from wattframe.operators.resolve import merge_resolved
    orig = spark.createDataFrame([(1, None, "A"), (2, None, "A"), (3, "h1", "A")], "rid long, hour string, city string")
    resolved = orig.filter("rid = 2")
    out = sorted(r["rid"] for r in merge_resolved(orig, resolved, "hour", "city").collect())
    assert out == [2, 3]


def test_balanced_sample_strict_cap_with_ties(spark):
    from wattframe.operators.sampling import balanced_sample
    df = spark.createDataFrame([("a", 1)] * 10, "c string, v int")
    assert balanced_sample(df, "c", 3, ["v"]).count() == 3


def test_csv_inferred_types(spark):
    df = spark.createDataFrame([(1, 2.5, "x")], "a int, b double, c string")
    path = io.write_csv(df, scratch_path(spark, "t-infer"))
    back = io.read_csv(spark, path, None)
    assert dict(back.dtypes) == {"a": "int", "b": "double", "c": "string"}


def test_wide_text_measures_dictionary_and_fallback_agree(spark):
    rows = [("h1", "A", "x", 1.0), ("h1", "B", "y", 2.0), ("h2", "A", "y", None), ("h3", "B", None, 3.0)]
    df = spark.createDataFrame(rows, "k string, e string, s string, v double")
    a = {r["k"]: r.asDict() for r in reshape.to_wide(df, "k", "e", ["A", "B"], ["s", "v"], dictionaries={"s": ["y", "x"]}).collect()}
    b = {r["k"]: r.asDict() for r in reshape.to_wide(df, "k", "e", ["A", "B"], ["s", "v"]).collect()}
    assert a == b
    assert a["h2"]["s_B"] is None and a["h3"]["s_B"] is None and a["h1"]["s_B"] == "y"


def test_wide_text_measures_stay_hash_aggregated(spark):
    df = spark.createDataFrame([("h1", "A", "x"), ("h2", "B", "y")], "k string, e string, s string")
    plan = reshape.to_wide(df, "k", "e", ["A", "B"], ["s"], dictionaries={"s": ["x", "y"]})._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_model_save_and_load(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    df = spark.createDataFrame([(float(i), float(i % 7), 2.0 * i) for i in range(60)], "a double, b double, y double")
    asm = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    pipe = Pipeline(stages=[asm, GBTRegressor(labelCol="y", maxIter=3, seed=1)]).fit(df)
    single = GBTRegressor(labelCol="y", maxIter=3, seed=1).fit(asm.transform(df))
    for model, data in ((pipe, df), (single, asm.transform(df))):
        path = io.save_model(model, scratch_path(spark, "t-model"))
        back = io.load_model(path)
        a = [r.prediction for r in model.transform(data).collect()]
        b = [r.prediction for r in back.transform(data).collect()]
        assert a == b and type(back).__name__ == type(model).__name__


def test_random_options(spark):
    from wattframe.operators.sampling import balanced_sample, hash_split
    df = spark.range(0, 1000).select("id", (F.col("id") % 4).cast("string").alias("c"))
    a, b = hash_split(df, ["id"], 0.6, method="random")
    assert a.count() + b.count() == 1000 and 450 < a.count() < 750
    s = balanced_sample(df, "c", 10, ["id"], order="random")
    assert {r["count"] for r in s.groupBy("c").count().collect()} == {10}
