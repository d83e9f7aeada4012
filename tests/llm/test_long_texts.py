"""Texts longer than a slice (2 MiB) between short ones, against the same brute-force versions as small tables."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from wattframe.llm import bpe, langid, quality
from wattframe.llm.arrow_text import SLICE_BYTES

from . import test_bpe, test_packing, test_quality, test_rans, test_simhash
from .test_bpe import tik  # noqa: F401


@pytest.fixture(scope="module")
def long_texts():
    rnd = random.Random(5)
    words = ["the", "of", "Größe", "你好", "x1", "don't", "a\nb", "km²", "🙂", "river", "stone", "light", "#", "<b>"]
    one = " ".join(rnd.choice(words) for _ in range(520_000))
    assert len(one.encode()) > SLICE_BYTES + 100_000
    line = "\n".join(f"line {i % 999} {rnd.randrange(50)}" for i in range(190_000))
    assert len(line.encode()) > SLICE_BYTES
    return ["short text", one, None, line, "", "another short text", one + " end"]


@pytest.fixture(scope="module")
def long_docs(llm, long_texts):
    return llm.createDataFrame(list(enumerate(long_texts)), "doc_id long, text string").coalesce(1)


def test_quality_counts(long_texts):
    counts, x = quality.statistics(pa.array(long_texts))
    assert list(zip(*(counts[c].tolist() for c in quality.COUNTS))) == [test_quality.slow(t) for t in long_texts]
    assert np.isfinite(x).all()


def test_byte_bpe(long_docs, long_texts, tik):  # noqa: F811
    rows = {r["doc_id"]: r for r in bpe.encode_decode(long_docs, test_bpe.RANKS, with_ids=False).drop("text").collect()}
    for i, t in enumerate(long_texts):
        ids = tik.encode_ordinary(t or "")
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_simhash_fingerprints(long_docs):
    test_simhash.check(long_docs)


def test_packing_keeps_every_piece(long_docs):
    test_packing.check(long_docs)


def test_rans_round_trip(llm, long_docs):
    test_rans.check(llm, long_docs)


def test_language_of_long_texts(llm):
    """A long text gets the score of its whole text, not of a beginning."""
    rnd = random.Random(2)
    near = [" ".join(rnd.choice(["river", "stone", "light", "water"]) for _ in range(60)) for _ in range(40)]
    far = [" ".join(rnd.choice(["fluss", "stein", "licht", "wasser"]) for _ in range(60)) for _ in range(40)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in near] + [(t, "de") for t in far])]
    long = near[0] + " " + " ".join(rnd.choice(["fluss", "stein", "licht", "wasser"]) for _ in range(400_000))
    assert len(long) > SLICE_BYTES
    model = langid.learn(llm.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.predict(llm.createDataFrame([(900, long), (901, near[1])], "doc_id long, text string"), model)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {900: "de", 901: "en"}
