"""Batched boosting against a plain single-node version, and its stopping, resuming and layout."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.operators import boosting as B

X = ["a", "b", "c"]
SCHEMA = "k long, a double, b double, c double, y double, z double, fold int"


def _rows(n=900):
    out = []
    for i in range(n):
        a, b, c = math.sin(i * 1.7), float(i * 7919 % 31), (i * 104729 % 997) / 997
        y = 10 * a + (b if b > 12 else -c * 4) + (i * 31 % 11) / 5
        out.append((i, None if i % 17 == 0 else a, float("nan") if i % 23 == 0 else b, c, None if i % 101 == 0 else y, b * c, i % 3))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


def _folds(df, k=3):
    return df.select("*", *[(F.col("fold") == f).alias(f"out{f}") for f in range(k)])


def _plain(data, keys, y, fitted, m, cuts, base, rounds, steps):
    """Trees as {node: (feature, bin, missing left)} and margins, row by row and node by node."""
    bins = [[0 if x is None or math.isnan(x) else 1 + sum(e < x for e in cuts[j]) for j, x in enumerate(r)] for r in data]
    margin, trees = [base] * len(data), []

    def toward(g):
        return math.copysign(max(abs(g) - m.alpha, 0), g)

    def worth(g, n):
        return toward(g * steps) ** 2 / (n + m.reg_lambda)

    for r in range(rounds):
        drawn = B._drawn(keys, m.subsample, m.seed, r)
        use = [i for i in fitted if drawn[i]]
        g = {i: round((margin[i] - y[i]) / steps) for i in use}
        columns, tree, value = B._columns(m, r, X), {}, {}

        def split(node, members, depth):
            G, n = sum(g[i] for i in members), len(members)
            value[node] = -toward(G * steps) / (n + m.reg_lambda) * m.learning_rate
            best = None
            for f in columns if depth < m.max_depth else []:
                for b in range(1, len(cuts[f]) + 2):
                    for left_missing in (False, True):
                        left = [i for i in members if (left_missing if bins[i][f] == 0 else bins[i][f] <= b)]
                        if min(len(left), n - len(left)) < m.min_child_weight:
                            continue
                        gl = sum(g[i] for i in left)
                        gain = worth(gl, len(left)) + worth(G - gl, n - len(left)) - worth(G, n)
                        if best is None or gain > best[0]:
                            best = (gain, f, b, left_missing, left)
            if best and best[0] > 0:
                tree[node] = tuple(map(int, best[1:4]))
                inside = set(best[4])
                split(2 * node + 1, best[4], depth + 1)
                split(2 * node + 2, [i for i in members if i not in inside], depth + 1)

        split(0, use, 0)
        trees.append(tree)
        for i in range(len(data)):
            node = 0
            while node in tree:
                f, b, left_missing = tree[node]
                node = 2 * node + 1 + (not (left_missing if bins[i][f] == 0 else bins[i][f] <= b))
            margin[i] += value[node]
    return trees, margin


@pytest.mark.parametrize("alpha", [0.0, 10.0])
def test_equals_a_plain_single_node_version(spark, rows, alpha):
    m = B.Boost("y", "y", 0.2, 3, 3, alpha=alpha, holdout="out0")
    df = _folds(rows)
    fitted = B.fit(df, ["k"], X, [m], max_bins=12)
    keys = {r["k"]: r["h"] for r in df.select("k", F.xxhash64("k").alias("h")).collect()}
    data = _rows()
    ys = [math.nan if r[4] is None else r[4] for r in data]
    known = [v for v in ys if not math.isnan(v)]
    mine = [i for i, r in enumerate(data) if r[4] is not None and r[6] != 0]
    hashes = np.array([keys[r[0]] for r in data], dtype=np.int64).astype(np.uint64)
    trees, margin = _plain([r[1:4] for r in data], hashes, ys, mine, m, fitted.cuts, fitted.base[0], 3, (max(known) - min(known)) / B.STEPS)
    got = [{int(i): (int(t["feature"][i]), int(t["bin"][i]), int(t["missing_left"][i])) for i in np.flatnonzero(t["feature"] >= 0)}
           for t in fitted.trees[0]]
    assert got == trees and sum(map(len, trees)) > 6
    pred = {r["k"]: r["p"] for r in fitted.transform(df, {"y": "p"}).collect()}
    assert np.allclose([pred[r[0]] for r in data], margin, rtol=0, atol=1e-9)
    assert fitted.base[0] == pytest.approx(np.mean([ys[i] for i in mine]))
    for part, name in ((mine, 2), ([i for i, r in enumerate(data) if r[4] is not None and r[6] == 0], 3)):
        rmse = math.sqrt(np.mean([(margin[i] - ys[i]) ** 2 for i in part]))
        assert fitted.errors[-1][name] == pytest.approx(rmse) and fitted.errors[-1][:2] == ("y", 2)


def test_models_together_equal_models_alone_and_after_a_repartition(rows):
    models = [B.Boost("y5", "y", 0.1, 5, 4, alpha=1.0), B.Boost("z2", "z", 0.3, 2, 6, skip=("b",)), B.Boost("y1", "y", 0.1, 3, 5, holdout="out1")]
    df = _folds(rows)
    together = B.fit(df.repartition(7, "c"), ["k"], X, models)
    for i, m in enumerate(models):
        alone = B.fit(df.coalesce(1), ["k"], X, [m])
        assert len(alone.trees[0]) == m.n_estimators and _same(alone.trees[0], together.trees[i])


def _same(a, b):
    return len(a) == len(b) and all(np.array_equal(s[k], t[k]) for s, t in zip(a, b) for k in ("feature", "bin", "missing_left", "value"))


def test_early_stop_runs_no_job_after_the_stop(rows, monkeypatch):
    df = _folds(rows)
    models = [B.Boost(f"f{f}", "y", 0.9, 5, 200, holdout=f"out{f}", group="cv") for f in range(3)]
    calls = []
    level = B._level
    monkeypatch.setattr(B, "_level", lambda *a: calls.append(a[8]) or level(*a))
    fitted = B.fit(df, ["k"], X, models, early_stop=3)
    mean = {}
    for _, r, _, held in fitted.errors:
        mean.setdefault(r, []).append(held)
    mean = {r: sum(v) / 3 for r, v in mean.items()}
    best = min(mean, key=mean.get)
    assert max(mean) == best + 3 < 199 and max(calls) == best + 4  # the pass that measures the last round is the last
    assert [len(t) for t in fitted.trees] == [best + 1] * 3


def test_resumed_equals_uninterrupted(spark, rows, tmp_path):
    df = _folds(rows)
    models = [B.Boost("p", "y", 0.2, 4, 9, holdout="out0", group="g"), B.Boost("q", "z", 0.2, 3, 7)]
    whole = B.fit(df, ["k"], X, models, every=3)
    state = str(tmp_path / "state")
    part = B.fit(df, ["k"], X, models, every=3, state=state, stop_after=5)
    assert len(part.trees[0]) == 5
    again = B.fit(df, ["k"], X, models, every=3, state=state)
    assert all(_same(a, b) for a, b in zip(again.trees, whole.trees)) and again.errors == whole.errors
    with pytest.raises(ValueError):
        B.fit(df, ["k"], X, [B.Boost("p", "y", 0.3)], state=state)


def test_odd_tables(spark, rows):
    m = [B.Boost("m", "y", 0.2, 2, 2)]
    none = B.fit(rows.limit(0), ["k"], X, m)
    assert [r["p"] for r in none.transform(rows.limit(3), {"m": "p"}).collect()] == [0.0] * 3
    same = spark.createDataFrame([(i, 1.0, None, float("nan"), 5.0, 1.0, 0) for i in range(20)], SCHEMA)
    assert {r["p"] for r in B.fit(same, ["k"], X, m).transform(same, {"m": "p"}).collect()} == {5.0}
    with pytest.raises(ValueError):
        B.fit(rows, ["k"], X, m * 2)
    with pytest.raises(ValueError):
        B.fit(rows, ["k"], ["a"], [B.Boost("m", "y", skip=("a",))])
    with pytest.raises(ValueError):
        B.fit(rows, ["k"], X, m, max_bins=300)


def test_nodes_give_the_splits_by_value(spark, rows):
    fitted = B.fit(rows, ["k"], X, [B.Boost("m", "y", 0.2, 3, 2)])
    nodes = fitted.nodes(spark).collect()
    inner = {(r["tree"], r["node"]) for r in nodes if r["feature"]}
    assert {(r["tree"], (r["node"] - 1) // 2) for r in nodes if r["node"]} == inner
    assert all(r["threshold"] is not None for r in nodes if r["feature"])
