"""Byte-level BPE against tiktoken and the tokenizers library, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from wattframe.llm import bpe

from .conftest import ODD_TEXTS, SF

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strange(n):
    rnd = random.Random(n)
    sets = ["ab ", "aaab", " \n\t", "é à ñ", "    　a", "你好 🙂", "'s 't're'LL", "<|endoftext|> ", "0123 .", "\u0085\x1c\x1f x", "ﬁ‍́ e", "ª²¹º ×÷ ", "ÀÖØöøɏ ɐ", "a's'S ", "\r\n .,"]
    return ["".join(rnd.choice(rnd.choice(sets)) for _ in range(rnd.randrange(60))) for _ in range(n)] + \
        ["".join(rnd.choice(s) for _ in range(40)) for s in sets for _ in range(20)]


@pytest.mark.parametrize("path", [JSON, RANKS])
def test_ids_equal_the_libraries(llm, tik, path):
    texts = [r["text"] for r in llm.read.parquet(f"{SF}/documents.parquet").collect()] + ODD_TEXTS + strange(3000) + ["<|endoftext|> a<|endoftext|>"]
    ids, at = bpe.encoder(path).encode(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    assert got == [tik.encode_ordinary(t or "") for t in texts]
    hf = Tokenizer.from_file(JSON)
    hf.encode_special_tokens = True
    assert got == [e.ids for e in hf.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_decoding_and_spans(llm):
    texts = [t or "" for t in ODD_TEXTS] + strange(300)
    enc = bpe.encoder(RANKS)
    ids, at = enc.encode(pa.array(texts))
    data, ends = enc.decode(ids, at)
    assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == texts
    first, last = enc.spans(ids, at, data)
    for t, a, b in zip(texts, at, at[1:]):
        for i in range(a, b):
            piece = data[0:0]
            piece = enc.token_bytes[enc.token_at[ids[i]]:enc.token_at[ids[i] + 1]].tobytes()
            assert piece in t[first[i]:last[i]].encode() and last[i] - first[i] <= len(piece)
    hf = Tokenizer.from_file(JSON)
    plain = ["a b é", " don't stop  now", "one\ntwo"]
    ids, at = enc.encode(pa.array(plain))
    first, last = enc.spans(ids, at, enc.decode(ids, at)[0])
    want = [o for e in hf.encode_batch(plain, add_special_tokens=False) for o in e.offsets]
    assert len(want) == len(first) and all(f <= o[0] and o[1] == e for f, e, o in zip(first, last, want))


def test_rows(llm, odd_docs, no_docs, tik):
    rows = bpe.encode_decode(odd_docs, RANKS).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        text = r["text"] or ""
        ids = tik.encode_ordinary(text)
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), text)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(no_docs, JSON).collect() == []


def test_small_cache_changes_nothing(monkeypatch):
    texts = [f"word{i} again {i}" for i in range(500)]
    enc = bpe.Encoder(JSON)
    want = enc.encode(pa.array(texts))
    monkeypatch.setattr(bpe, "CACHE", 10)
    for _ in range(3):
        enc.encode(pa.array([f"other{i} word7" for i in range(300)]))
        got = enc.encode(pa.array(texts))
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])


def test_query_has_a_checksum_of_the_spans(llm):
    from pyspark.sql import functions as F

    from wattframe.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    enc = bpe.encoder(RANKS)
    ids, at = enc.encode(pa.array(list(docs.values())))
    first, last = enc.spans(ids, at, enc.decode(ids, at)[0])
    rows = [(i, first[a:b].tolist(), last[a:b].tolist()) for i, a, b in zip(docs, at, at[1:])]
    want = llm.createDataFrame(rows, "doc_id long, starts array<long>, ends array<long>").select("doc_id", F.xxhash64("starts", "ends"))
    got = QUERIES["op3_byte_bpe"](llm, SF).select("doc_id", "spans_xxh64")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
