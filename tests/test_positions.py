"""Exact positions: against plain sorting, with gaps, ties, nulls, hot values and empty tables."""

import random

import pytest

from wattframe.operators import positions as P


def gappy(spark, n, parts):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 5, 5, 5, rnd.randrange(10 ** 6)]), i, f"v{i}") for i in range(n)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "t long, id long, v string").repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_equal_sorted_order(spark, parts):
    rows, df = gappy(spark, 3000, parts)
    want = {r[1]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    got = P.with_positions(df, ["t", "id"], "at", "rows").collect()
    assert {r["id"]: r["at"] for r in got} == want and {r["rows"] for r in got} == {3000}


@pytest.mark.parametrize("n,k", [(10, 3), (11, 3), (12, 4), (3, 5), (1001, 2)])
def test_folds_have_equal_sizes(spark, n, k):
    _, df = gappy(spark, n, 3)
    order = sorted(P.with_positions(P.positional_folds(df, ["t", "id"], k), ["t", "id"]).select("position", "fold").collect())
    folds = [r["fold"] for r in order]
    assert folds == sorted(folds) and [folds.count(f) for f in range(k)] == [n // k + (f < n % k) for f in range(k)]


def test_split_and_concat(spark):
    rows, df = gappy(spark, 500, 4)
    out = P.positional_split(df, ["id"], {"train": (None, 300), "validation": (310, 400), "test": (400, None)}).collect()
    assert {r["id"]: r["split"] for r in out} == {i: "train" if i < 300 else "validation" if i < 400 else "test" for i in range(500) if not 300 <= i < 310}
    other = spark.createDataFrame([(i * i, ) for i in range(400)], "square long")
    pairs = P.concat_columns(df.select("id"), other, ["id"], ["square"])
    assert {(r["id"], r["square"]) for r in pairs.collect()} == {(i, i * i) for i in range(400)}
    assert P.concat_columns(df.select("id"), other, ["id"], ["square"], "full").count() == 500


def test_no_window_over_the_whole_table(spark):
    _, df = gappy(spark, 50, 2)
    plan = P.with_positions(df, ["t", "id"])._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "Aggregate" in window.split("Relation")[0]  # windows stand on one row per range


def test_empty_and_bad_arguments(spark):
    _, df = gappy(spark, 5, 1)
    assert P.positional_folds(df.limit(0), ["id"], 3).count() == 0
    for bad in (lambda: P.with_positions(df, []), lambda: P.with_positions(df, ["id"], "v"), lambda: P.positional_folds(df, ["id"], 1),
                lambda: P.positional_split(df, ["id"], {"a": (0, 5), "b": (4, 9)}), lambda: P.concat_columns(df, df, ["id"], ["id"])):
        with pytest.raises(ValueError):
            bad()
