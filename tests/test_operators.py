"""Operator semantics on small hand-made frames (FIXTURES.md cases) and invariants."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.functions.text import day_night_icon, repair_text
from wattframe.functions.time import calendar_parts, parse_offset_timestamp
from wattframe.operators import evaluate, features, impute, profile, reshape, sampling, sequences
from wattframe.plans.weather import clean_rows
from wattframe.schemas import DESCRIPTION_RULES, ENERGY_TOTALS


def test_text_repair_chain(spark):
    df = spark.createDataFrame([("light shower sleet",), ("shower sleet",), ("proximity squalls",), (None,)], "d string")
    out = [r[0] for r in df.select(repair_text("d", DESCRIPTION_RULES)).collect()]
    assert out == ["light shower sleet", "light shower sleet", "squalls", None]
    legacy = [r[0] for r in df.select(repair_text("d", DESCRIPTION_RULES, collapse=False)).collect()]
    assert legacy[0] != "light shower sleet"  # the blank-inserting rule breaks the plain chain


def test_icon_suffix(spark):
    df = spark.createDataFrame([("01",), ("01n",)], "i string")
    assert [r[0] for r in df.select(day_night_icon("i")).collect()] == ["01d", "01n"]


def test_impute_mean_skips_null_and_nan(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0), (4, 5.0)], "id int, x double")
    out = {r["id"]: r["x"] for r in impute.impute_means(df).collect()}
    assert out == {1: 3.0, 2: 3.0, 3: 1.0, 4: 5.0}
    assert impute.impute_means(df).columns == ["id", "x"]


def test_utc_calendar_parts(spark):
    df = spark.createDataFrame([("2018-01-01 00:00:00+01:00",)], "t string")
    row = df.select(parse_offset_timestamp("t").alias("ts")).select(*[v.alias(k) for k, v in calendar_parts("ts").items()]).first()
    assert (row["year"], row["hour"], row["month"], row["weekday"]) == (2017.0, 23.0, 12.0, 6.0)


def test_month_is_kept_by_parser(spark):
    df = spark.createDataFrame([("2018-07-14 10:00:00+02:00",)], "t string")
    ts = df.select(parse_offset_timestamp("t").alias("ts")).first()["ts"]
    assert ts == dt.datetime(2018, 7, 14, 8, 0)


def test_energy_totals_null_propagation(spark):
    cols = sorted({p for parts in ENERGY_TOTALS.values() for p in parts if not p.startswith("gen_")})
    vals = {c: 1.0 for c in cols}
    vals["generation fossil gas"] = None
    df = spark.createDataFrame([tuple(vals[c] for c in cols)], ", ".join(f"`{c}` double" for c in cols))
    out = reshape.energy_totals(df, keep=[], totals=ENERGY_TOTALS).first().asDict()
    assert out["gen_fossil_totals"] is None
    assert out["gen_hydro_totals"] == 3.0 and out["gen_renewable_totals"] == 1 + 3 + 1 + 1 + 2


def test_wide_then_long_roundtrip(spark):
    rows = [("h1", "A", 1.0), ("h1", "B", 2.0), ("h2", "A", 3.0)]
    df = spark.createDataFrame(rows, "k string, e string, v double")
    wide = reshape.to_wide(df, "k", "e", ["A", "B"], ["v"])
    assert sorted(wide.columns) == ["k", "v_A", "v_B"]
    back = reshape.to_long(wide, "k", ["v_A", "v_B"]).dropna()
    got = sorted((r["k"], r["series"][2:], r["value"]) for r in back.collect())
    assert got == sorted(rows)


def test_duplicate_matrix_brute_force(spark):
    rows = [("h1", "A"), ("h1", "A"), ("h1", "B"), ("h2", "B"), ("h2", "B"), ("h2", "B"), ("h3", "A")]
    df = spark.createDataFrame(rows, "k string, e string")
    m = {r["k"]: r.asDict() for r in profile.duplicate_matrix(df, "k", "e", ["A", "B"]).collect()}
    assert set(m) == {"h1", "h2"}
    assert (m["h1"]["counts_A"], m["h1"]["counts_B"], m["h1"]["all_dupl"]) == (2, 0, False)
    assert (m["h2"]["counts_A"], m["h2"]["counts_B"]) == (0, 3)


def test_repeat_in_one_entity_excluded_for_all(spark):
    rows = [("h1", "A", 1), ("h1", "A", 2), ("h1", "B", 3), ("h2", "A", 4), ("h2", "B", 5), ("h2", "C", 6)]
    df = spark.createDataFrame(rows, "k string, e string, id int")
    dup = profile.duplicate_matrix(df, "k", "e", ["A", "B", "C"]).select("k")
    assert sorted(r["id"] for r in clean_rows(df, "k", dup).collect()) == [4, 5, 6]


def test_balanced_sample_cap_and_repeatable(spark):
    df = spark.range(0, 500).select(F.col("id"), (F.col("id") % 3).cast("string").alias("c"))
    a = sampling.balanced_sample(df, "c", 20, ["id"])
    counts = {r["c"]: r["count"] for r in a.groupBy("c").count().collect()}
    assert counts == {"0": 20, "1": 20, "2": 20}
    b = sampling.balanced_sample(df.repartition(7), "c", 20, ["id"])
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())
    with pytest.raises(ValueError):
        sampling.balanced_sample(df, "missing", 5)


def test_sequences_equal_numpy_slices(spark):
    n, h = 30, 24
    xs = [float(i * i % 7) for i in range(n)]
    df = spark.createDataFrame([(i, xs[i], xs[i] * 2) for i in range(n)], "idx long, x double, y double")
    seq = {r["idx"]: r for r in sequences.build_sequences(df, "idx", "x", "y", history=h).collect()}
    assert sorted(seq) == list(range(h, n)) and len(seq) == 6
    arr = np.array(xs)
    for i, r in seq.items():
        assert r["history"] == list(arr[i - h:i]) and r["label"] == xs[i] * 2


def test_sequences_do_not_cross_splits(spark):
    df = spark.createDataFrame([(i, float(i), float(i), "a" if i < 30 else "b") for i in range(60)],
                               "idx long, x double, y double, s string")
    out = sequences.build_sequences(df, "idx", "x", "y", history=24, split_col="s").collect()
    assert sorted(r["idx"] for r in out) == list(range(24, 30)) + list(range(54, 60))


def test_minmax_drops_constant_and_inverts(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, c double")
    m = features.fit_minmax(df)
    assert m.columns == ["a"]
    out = m.transform(df, "_s").select("a", "a_s", m.inverse_column("a_s", "a").alias("back")).collect()
    assert [r["a_s"] for r in out] == [0.0, 1 / 3, 1.0]
    assert all(math.isclose(r["back"], r["a"]) for r in out)


def test_centred_pca_matches_svd(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 10
    df = spark.createDataFrame([(i, Vectors.dense(r.tolist())) for i, r in enumerate(x)], ["id", "features"])
    model = features.fit_centred_pca(df, "features", "pca", 0.80)
    xc = x - x.mean(axis=0)
    s = np.linalg.svd(xc, compute_uv=False) ** 2
    k = int(np.searchsorted(np.cumsum(s / s.sum()), 0.80) + 1)
    assert model.k == k
    scores = np.array([r[0] for r in model.transform(df).select(vector_to_array("pca")).collect()])
    assert np.allclose(scores.mean(axis=0), 0, atol=1e-8)


def test_classification_metrics_brute_force(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("c", "c"), ("b", "b")]
    df = spark.createDataFrame(pairs, "label string, pred string")
    m = {(r["label"], r["metric"]): r["value"] for r in evaluate.classification_metrics(df, "label", "pred").collect()}
    assert math.isclose(m[("ALL", "accuracy")], 4 / 6)
    assert m[("a", "precision")] == 0.5 and m[("a", "recall")] == 0.5
    assert math.isclose(m[("ALL", "hamming_loss")], 2 * 2 / (6 * 3))


def test_rmse_counts_null_pairs(spark):
    df = spark.createDataFrame([("m", "t", 1.0, 2.0), ("m", "t", 3.0, None)], "model string, target string, actual double, predicted double")
    r = evaluate.rmse_matrix(df).first()
    assert (r["rmse"], r["n_pairs"], r["n_null_pairs"]) == (1.0, 1, 1)


def test_contiguous_folds(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1) + dt.timedelta(hours=i),) for i in range(10)], "ts timestamp_ntz")
    folds = [r[0] for r in df.select(sampling.contiguous_folds(df, "ts", 2)).collect()]
    assert folds == [0] * 5 + [1] * 5


def test_quality_checks(spark):
    df = spark.createDataFrame([("h1", "A", 1.0), ("h1", "B", None), ("h2", "A", 2.0)], "k string, e string, v double")
    r = profile.quality_checks(df, "k", "e", ["A", "B"]).first()
    assert (r["n_rows"], r["n_rows_with_null"], r["n_keys"], r["expected_rows"], r["complete"]) == (3, 1, 2, 4, False)


@pytest.mark.parametrize("offset,horizon", [(0, 1), (0, 3), (2, 1)])
def test_sequence_methods_agree(spark, offset, horizon):
    n = 200
    rows = [(i, float(i * 7 % 13), float(i), "a" if i < 90 else "b") for i in range(n) if i not in (40, 41)]
    df = spark.createDataFrame(rows, "idx long, x double, y double, s string")
    kw = dict(history=24, target_offset=offset, horizon=horizon, split_col="s")
    a = {(r["s"], r["idx"]): (r["history"], r["label"])
         for r in sequences.build_sequences(df, "idx", "x", "y", method="blocks", block_size=32, **kw).collect()}
    b = {(r["s"], r["idx"]): (r["history"], r["label"])
         for r in sequences.build_sequences(df, "idx", "x", "y", method="explode", **kw).collect()}
    assert a == b and len(a) > 50


def test_hamming_loss_counts_labels_only(spark):
    """Against Spark's own evaluator, with a class that is only predicted and one that is only a label."""
    from pyspark.ml.evaluation import MultilabelClassificationEvaluator
    from wattframe.operators.evaluate import classification_metrics
    pairs = [(0.0, 0.0), (0.0, 2.0), (1.0, 1.0), (1.0, 0.0), (3.0, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame(pairs, "label double, prediction double")
    sets = spark.createDataFrame([([p], [lab]) for lab, p in pairs], "prediction array<double>, label array<double>")
    want = MultilabelClassificationEvaluator(metricName="hammingLoss").evaluate(sets)
    got = {(r["label"], r["metric"]): r["value"] for r in classification_metrics(df, "label", "prediction").collect()}
    assert abs(got["ALL", "hamming_loss"] - want) < 1e-12
    swapped = {(r["label"], r["metric"]): r["value"] for r in classification_metrics(df, "label", "prediction", label_first=True).collect()}
    assert swapped["0.0", "precision"] == got["0.0", "recall"] and swapped["0.0", "recall"] == got["0.0", "precision"]


def test_repeated_index_raises(spark):
    import pytest
    from wattframe.operators import sequences
    rows = [(i, float(i), float(i)) for i in [*range(30), 12]]
    df = spark.createDataFrame(rows, "idx long, x double, y double")
    for method in ("blocks", "explode"):
        with pytest.raises(Exception, match="a time index is repeated"):
            sequences.build_sequences(df, "idx", "x", "y", history=24, method=method).collect()


def test_undeclared_text_raises(spark):
    import pytest
    from wattframe.operators.reshape import to_wide
    df = spark.createDataFrame([("h1", "A", "x"), ("h2", "A", "z")], "k string, e string, s string")
    with pytest.raises(Exception, match="not in its dictionary"):
        to_wide(df, "k", "e", ["A"], ["s"], dictionaries={"s": ["x"]}).collect()


def test_unknown_tree_settings_raise():
    import pytest
    from wattframe.plans.forecast import gbt
    with pytest.raises(TypeError):
        gbt("y", learning_rte=0.1)
