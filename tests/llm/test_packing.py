"""Packing: every token once, gapless sequences, the tightest window, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from wattframe.llm import packing as K

from .conftest import SF

JSON = P.path("byte_bpe_50k.json")


def slow_best_fit(lengths, capacity):
    """Capacities used by best fit decreasing with a plain scan."""
    left, out = [], []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
        out.append(sorted(left))
    return sorted(left)


@pytest.mark.parametrize("capacity", [1, 7, 16, 1024])
def test_best_fit_equals_plain_scan(capacity):
    rnd = random.Random(capacity)
    lengths = np.array([rnd.randint(1, capacity) for _ in range(400)])
    window, offset, made = K.best_fit(lengths, capacity)
    fill = np.bincount(window, lengths, made).astype(int)
    assert sorted(capacity - fill) == slow_best_fit(lengths.tolist(), capacity)
    order = np.lexsort((offset, window))
    ends = offset + lengths
    same = window[order][1:] == window[order][:-1]
    assert (offset[order][1:][same] == ends[order][:-1][same]).all() and (offset[order][1:][~same] == 0).all()


def check(docs, **how):
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    want = sorted((str(r["doc_id"]), tok.encode(r["text"] or "", add_special_tokens=False).ids + [0])
                  for r in docs.select("doc_id", "text").collect())
    rows = K.pack(docs, JSON, **how).collect()
    seqs, docs_ids = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        seqs[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"]))
        docs_ids[str(r["doc_id"])].append((r["start"], r["ids"], r["doc_tokens"]))
    for pieces in seqs.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and {p[2] for p in pieces} == {at if at & (at - 1) == 0 else 1024}
    total = defaultdict(int)
    for i, ids in want:
        total[i] += len(ids)
    assert {i: sum(len(p[1]) for p in ps) for i, ps in docs_ids.items()} == dict(total)
    count = defaultdict(int)
    for i, _ in want:
        count[i] += 1
    for i, ids in want:
        if count[i] == 1:
            pieces = sorted(docs_ids[i], key=lambda p: p[0])
            assert [x for p in pieces for x in p[1]] == ids and {p[2] for p in pieces} == {len(ids)}
            assert [p[0] for p in pieces] == [sum(len(q[1]) for q in pieces[:k]) for k in range(len(pieces))]
    return sum({s: p[0][2] for s, p in seqs.items()}.values()), sum(total.values())


def test_whole_table(llm):
    padded, tokens = check(llm.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert padded < 1.01 * tokens


@pytest.mark.parametrize("buffer_tokens", [K.BUFFER_TOKENS, 100])
def test_odd_rows(odd_docs, no_docs, buffer_tokens):
    check(odd_docs, buffer_tokens=buffer_tokens)
    assert K.pack(no_docs, JSON).collect() == []
    assert SF
