"""Quality statistics against a plain count, the trees' constraints and held-out accuracy."""

import re

import numpy as np
import pyarrow as pa

from wattframe.llm import quality as Q

from .conftest import ODD_TEXTS, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_equal_plain_python(llm):
    texts = [r["text"] for r in llm.read.parquet(f"{SF}/documents.parquet").collect()] + ODD_TEXTS
    texts += ["\n", "\n\na\n", "a\n", "\na", "b b b b b b\nb b b b b b", "a\x0bb\x0cc\rd\r\na", " x y"]
    counts, x = Q.statistics(pa.array(texts))
    assert list(zip(*(counts[c].tolist() for c in Q.COUNTS))) == [slow(t) for t in texts]
    assert np.isfinite(x).all() and x.shape == (len(texts), len(Q.FEATURES))


def test_monotone_trees_never_rise(llm):
    rnd = np.random.default_rng(0)
    x = rnd.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(20 * x[:, 0]) + 0.2 * rnd.standard_normal(3000) < 0.6).astype(float)
    model = Q.fit_trees(x, y, np.array([-1, 0, 0]))
    grid = np.column_stack([np.linspace(-1, 2, 400), np.full(400, 0.3), np.full(400, 0.9)])
    assert (np.diff(model.score(grid)) <= 1e-12).all()
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.8


def test_scores_equal_a_walk_from_node_to_node():
    rnd = np.random.default_rng(4)
    x = rnd.random((800, 4))
    x[::9] = x[0]  # ties
    model = Q.fit_trees(x, (x[:, 0] * x[:, 1] + 0.1 * rnd.random(800) > 0.3).astype(float), np.zeros(4, dtype=int), rounds=15)

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    probe = np.vstack([x, rnd.random((200, 4)) * 3 - 1])
    assert len(model.roots) == 15 and np.allclose(model.score(probe), [walk(r) for r in probe], rtol=0, atol=1e-12)


def test_held_out_accuracy(llm):
    d = "/root/testdata/sf0.1"
    docs, labels = llm.read.parquet(f"{d}/documents.parquet"), llm.read.parquet(f"{d}/labels.parquet")
    model = Q.fit(docs, labels.filter("doc_id % 2 = 0"))
    got = Q.score(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "kept").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_odd_rows_and_missing_labels(llm, odd_docs, no_docs):
    labels = llm.createDataFrame([], "doc_id long, quality int")
    model = Q.fit(odd_docs, labels)
    got = Q.score(odd_docs, model)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and {"lang", "source", "spans"} <= set(got.columns)
    assert [r["kept"] for r in rows if r["text"] is None] == [False]
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert Q.score(no_docs, Q.fit(no_docs, labels)).collect() == []
