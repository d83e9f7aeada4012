"""rANS token files: exact round trips, random access from checkpoints, damage is noticed."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

from wattframe.llm import rans as R
from wattframe.session import scratch_path

from .conftest import SF

JSON = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n, symbols, block, lanes", [(0, 1, 8, 4), (1, 1, 8, 4), (7, 3, 8, 4), (8, 3, 8, 4), (9, 3, 8, 4),
                                                      (1000, 1, 64, 8), (5000, 300, 64, 8), (70000, 50257, 4096, 64), (3, 2**32 - 1, 8, 4)])
def test_segments_round_trip(n, symbols, block, lanes):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.zipf(1.2, n), symbols).astype(np.uint32) if symbols < 1 << 20 else rnd.integers(0, symbols, n, dtype=np.uint32)
    lengths = np.full(-(-n // 3) if n else 1, 3) if n else np.array([0])
    if n:
        lengths[-1] = n - 3 * (len(lengths) - 1)
    docs = np.arange(len(lengths)) * 5 - 7
    has = np.arange(len(lengths)) % 4 != 1
    payload = R.encode_segment(ids, docs, has, lengths, block, lanes)
    head = R.read_header(payload)
    assert np.array_equal(R.decode_blocks(payload, head), ids)
    assert np.array_equal(head["doc_ids"], docs) and np.array_equal(head["has_id"], has) and np.array_equal(head["lengths"], lengths)
    for a, b in ((0, len(lengths)), (len(lengths) // 2, len(lengths)), (len(lengths) // 3, len(lengths) // 2)):
        at = np.concatenate([[0], np.cumsum(lengths)])
        assert np.array_equal(R.decode_documents(payload, a, b), ids[at[a]:at[b]])


def test_close_to_the_entropy():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 300000), 5000).astype(np.uint32)
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    bits = -(p * np.log2(p)).sum() * len(ids)
    assert 8 * len(R.encode_segment(ids, np.zeros(1), np.ones(1, bool), np.array([len(ids)]))) < 1.05 * bits


def test_damage_is_noticed():
    ids = np.arange(5000, dtype=np.uint32) % 97
    payload = bytearray(R.encode_segment(ids, np.zeros(1), np.ones(1, bool), np.array([5000]), 1024, 16))
    payload[-3] ^= 1
    with pytest.raises(ValueError):
        R.decode_blocks(bytes(payload), R.read_header(bytes(payload)))


def mark(text):
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def check(spark, docs, **how):
    out = scratch_path(spark, "llm", "tokens")
    R.write_tokens(docs, out, JSON, **how)
    got = [tuple(r) for r in R.read_tokens(spark, out).collect()]
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1])))
    want, start = [], 0
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


@pytest.mark.parametrize("segment", [R.SEGMENT, 1000])
def test_whole_table(llm, segment):
    check(llm, llm.read.parquet(f"{SF}/documents.parquet").repartition(5), segment=segment)


def test_odd_rows(llm, odd_docs, no_docs):
    check(llm, odd_docs)
    check(llm, no_docs)


@pytest.mark.parametrize("n, block, lanes", [(1, 10, 4), (997, 10, 4), (1000, 64, 24)])
def test_ids_counted_or_sorted_give_one_file(monkeypatch, n, block, lanes):
    """The distinct ids come from a table or from sorting, with the same segment; blocks need not be whole lanes."""
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 5000).astype(np.uint32)
    args = (ids, np.zeros(1), np.ones(1, bool), np.array([n]), block, lanes)
    counted, payload = R.frequency_table(ids), R.encode_segment(*args)
    monkeypatch.setattr(R, "SMALL", 0)
    for a, b in zip(counted, R.frequency_table(ids), strict=True):
        assert np.array_equal(a, b)
    assert np.array_equal(counted[0][counted[3]], ids)
    assert R.encode_segment(*args) == payload
    assert np.array_equal(R.decode_blocks(payload, R.read_header(payload)), ids)
