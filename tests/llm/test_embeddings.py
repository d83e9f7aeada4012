"""Embedding near-duplicates against all pairs."""

import math

import numpy as np
import pytest

from wattframe.llm import embeddings as V

from .conftest import SF


def brute(rows, threshold=0.95):
    """Links by all pairs: number per row, component id, kept."""
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    dim = max((len(v) for _, v in rows if ok(v)), default=0)
    x = np.array([np.pad(np.array(v, float), (0, dim - len(v))) if ok(v) else np.zeros(dim) for _, v in rows]).reshape(len(rows), dim)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    out = []
    for i, (v, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(label == label[i]) if rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((v, int(near[i].sum()), c, v == c))
    return out, near


def key(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("how", [{}, {"block": 37}, {"cells": 60, "recall": 0.999, "block": 16}, {"cells": 1}])
def test_whole_table_equals_all_pairs(llm, how):
    df = llm.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert key(V.near_duplicates(df, **how).collect()) == key(brute(rows)[0])


def test_recall_at_the_threshold(llm):
    """Vectors built so that most links are only just over the threshold: at least 0.9 of them are found."""
    rnd = np.random.default_rng(2)
    base = rnd.standard_normal((700, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rnd.standard_normal((700, 64))
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    other = 0.955 * base + math.sqrt(1 - 0.955**2) * noise
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, other]).astype(np.float32))]
    got = V.near_duplicates(llm.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    found, all_ = sum(r["n_links"] for r in got), int(brute(rows)[1].sum())
    assert 0.9 * all_ <= found <= all_


def pairs_at_the_threshold(kind, rnd, n=5000):
    """Unit vectors in 64 dimensions and partners at cosine 0.955, the difference within the data's own directions."""
    rank = {"rank 4": 4, "rank 6": 6, "rank 8": 8}.get(kind, 64)
    basis = np.linalg.qr(rnd.standard_normal((64, rank)))[0]
    offset = 2 * np.eye(64)[0] if kind == "offset" else 0
    x = rnd.standard_normal((n, rank)) @ basis.T / np.sqrt(rank) + offset
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    way = rnd.standard_normal((n, rank)) @ basis.T
    way -= (way * x).sum(axis=1, keepdims=True) * x
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    return x, 0.955 * x + math.sqrt(1 - 0.955**2) * way


@pytest.mark.parametrize("kind", ["even", "rank 4", "rank 6", "rank 8", "offset"])
@pytest.mark.parametrize("cells", [100, 300, 1000])
def test_planted_pairs_meet(kind, cells):
    x, y = pairs_at_the_threshold(kind, np.random.default_rng(cells), 10_000)
    centres, margin = V.fitted_cells(np.concatenate([x[5000:], y[5000:]]), 10**6, cells=cells)  # other vectors than the pairs
    x, y = x[:5000], y[:5000]
    homes = [V._nearest(v, centres) for v in (x, y)]
    every = np.arange(len(centres))
    met = (homes[0] == homes[1])
    for v, mine, other in ((x, *homes), (y, *homes[::-1])):
        met |= V.visits(v, mine, centres, every, margin)[np.arange(len(v)), other]
    assert met.mean() >= 0.95


def test_visits_do_not_depend_on_the_other_rows():
    rnd = np.random.default_rng(1)
    x = rnd.integers(-2, 3, (300, 8)).astype(float)  # many ties
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = V.spherical_kmeans(x, 40)
    home, every = V._nearest(x, centres), np.arange(40)
    whole = V.visits(x, home, centres, every, 0.1)
    for i in range(0, 300, 7):
        for c in ([3], [0, 39], every[5:9]):
            assert (V.visits(x[i:i + 1], home[i:i + 1], centres, np.array(c), 0.1)[0] == whole[i, c]).all()


@pytest.mark.parametrize("kind", ["rank 4", "offset"])
def test_links_of_planted_pairs(llm, kind):
    """Whole results on hard data: at least 0.9 of all links, none below the threshold, one very long vector."""
    x, y = pairs_at_the_threshold(kind, np.random.default_rng(3), 600)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))] + [(5000, [1.0] * 4096)]
    got = {r["vec_id"]: r["n_links"] for r in V.near_duplicates(llm.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want, near = brute(rows)
    assert sum(got.values()) >= 0.9 * near.sum() and all(got[w[0]] <= w[1] for w in want)


@pytest.mark.parametrize("kind", ["even", "rank 4", "offset"])
def test_a_vector_visits_few_cells(kind):
    x, _ = pairs_at_the_threshold(kind, np.random.default_rng(7), 12_000)
    centres, margin = V.fitted_cells(x[:8000], 10**6, cells=1000)
    seen = V.visits(x[8000:], V._nearest(x[8000:], centres), centres, np.arange(1000), margin).sum(axis=1)
    assert seen.mean() < 60
    assert 250 <= len(V.fitted_cells(x[:8000], 10**6)[0]) <= 1000


def test_odd_vectors(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, [1.0]), (10, [0.0, 1.0, 0.0]), (11, [-0.0, 1.0]), (None, [1.0, 0.01]), (None, [0.0, 0.0, -1.0]),
            (12, [1e-38, 1e-38]), (13, [3e38, 3e38])]
    df = llm.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, n_links int, cell string")
    got = V.near_duplicates(df).collect()
    want, _ = brute(rows)
    assert key(got) == key(want)
    empty = llm.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.near_duplicates(empty).collect() == []


def test_double_components_keep_their_precision_and_range(llm):
    # 1e39 and 1e-60 have no finite, non-zero float; the last two vectors differ beyond a float's digits
    rows = [(1, [1e39, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1e-60]), (4, [0.0, 5.0]), (5, [1e200, 1e200]), (6, [1.0, 1.0]), (7, [1.0, 1.0 + 1e-12])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.near_duplicates(llm.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (2, 5), 6: (2, 5), 7: (2, 5)}
