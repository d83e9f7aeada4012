"""SimHash near-duplicates against brute force on whole small tables."""

import random
import re

import numpy as np
import pytest
import xxhash

from wattframe.llm import simhash as S
from wattframe.llm.components import connected_components

from .conftest import SF


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def slow_components(ids, fps, radius=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    members = {}
    for a in range(len(ids)):
        members.setdefault(find(a), []).append(ids[a])
    return [min((i for i in members[find(a)] if i is not None), default=None) for a in range(len(ids))]


def check(docs, **how):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted(map(str, zip((i for i, _ in rows), (f"{f:016x}" for f in fps), slow_components([i for i, _ in rows], fps))))
    got = S.near_duplicates(docs, **how)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_whole_table_equals_brute_force(llm):
    check(llm.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_no_rows(no_docs):
    assert S.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("block", [4096, 5])
def test_links_span_dense_groups_and_sub_blocks(llm, block):
    """A group of many distinct close fingerprints, also when it is dealt into small sub-blocks."""
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fps = {base ^ (1 << rnd.randrange(64)) for _ in range(40)} | {rnd.getrandbits(64) for _ in range(60)}
    fps |= {base ^ (7 << 3 * i) for i in range(10)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = S.linked(llm.createDataFrame([(f,) for f in signed], "fp long"), 2, block).collect()
    u = lambda x: x & (1 << 64) - 1
    assert all(u(e["a"]) in fps and u(e["b"]) in fps for e in edges)
    ids, fps = list(range(len(fps))), list(fps)
    want = slow_components(ids, fps)
    got = connected_components(llm.createDataFrame([tuple(e) for e in edges], "a long, b long"), "a", "b").collect()
    name = {u(r["node"]): r["component"] for r in got}
    classes = {}
    for i, f in enumerate(fps):
        classes.setdefault(name.get(f, f"alone {f}"), set()).add(want[i])
    assert all(len(c) == 1 for c in classes.values()) and len(classes) == len(set(want))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rnd = np.random.default_rng(5)
    fp = rnd.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp[100:200] = fp[:100] ^ (np.uint64(1) << rnd.integers(0, 63, 100).astype(np.uint64))
    fp[200:250] = fp[100:150] ^ np.uint64(0b10110)
    lo, hi = np.arange(300) + 1, np.full(300, 300)
    hi[250:] = 0
    got = {(int(a), int(b)) for i, j in S.close_pairs(fp, lo, hi, radius) for a, b in zip(i, j)}
    want = {(a, b) for a in range(250) for b in range(a + 1, 300) if bin(int(fp[a] ^ fp[b])).count("1") <= radius}
    assert got == want


def test_pigeonhole_bands_cover_every_pair():
    rnd = random.Random(1)
    for _ in range(500):
        a = rnd.getrandbits(64)
        b = a ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
        assert any(a & m == b & m for m in S.band_masks(2))


def test_one_row_of_each_group_stays(llm):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (1, text), (1, text), (2, "something else entirely here"), (None, text), (7, None), (8, "")]
    kept = S.representatives(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "7", "None"]


def test_different_texts_under_one_id_stay(llm):
    """Rows of one id go on by their texts, also where another text of the id is a copy."""
    copy = " ".join(f"a{i}" for i in range(50))
    rows = [(3, copy), (5, copy), (5, " ".join(f"z{i}" for i in range(50)))] + [(9, " ".join(f"{c}{i}" for i in range(40))) for c in "pqrs"]
    docs = llm.createDataFrame([(*r, "k") for r in rows + rows[-2:]], "doc_id long, text string, fp string")
    for how in (True, False):
        kept = S.representatives(docs, keep_unnamed=how)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == sorted((*r, "k") for r in rows if r != (5, copy))


def test_copies_without_an_id_go_in_the_pipeline(llm):
    import corpus_pipeline as C

    text, alone = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(None, text), (3, text), (None, text), (None, alone), (None, alone), (None, alone)]
    kept = dict(C.STAGES)["simhash"](llm, llm.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, kept), key=str) == [(3, text), (None, alone)]


def test_components_of_a_long_chain(llm):
    chain = llm.range(200).selectExpr("id u", "id + 1 v")
    got = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(201)}
