"""Language models against plain Kneser-Ney formulas, and held-out accuracy."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wattframe.llm import langid as L

from .conftest import ODD_TEXTS


def slow_symbols(text, alphabet):
    out = [0] * (L.ORDER - 1)
    for c in text or "":
        low = c.lower() if len(c.lower()) == 1 else c
        s = (alphabet.index(ord(low)) + 1 if ord(low) in alphabet else L.LETTERS + 1) if c.isalpha() else 0
        if s or len(out) > L.ORDER - 1 and out[-1]:
            out.append(s)
    return out + [0] * (len(out) == L.ORDER - 1 or out[-1] != 0)


def test_packed_grams_equal_plain_symbols():
    texts = ODD_TEXTS + ["İstanbul ΣΑΣ straße", "a1b", " a", "a ", "--", "ab  cd", "퟿ x"]
    alphabet = np.array(sorted(map(ord, "abcdeéso")), np.uint32)
    code, at = L.packed(*L.letters(pa.array(texts)), alphabet)
    for t, a, b in zip(texts, at, at[1:]):
        s = slow_symbols(t, alphabet.tolist())
        want = [sum(s[i - k] << L.BITS * k for k in range(L.ORDER)) for i in range(L.ORDER - 1, len(s))]
        assert code[a:b].tolist() == want, t


def slow_kneser(grams, counts):
    """P(last | rest) by the textbook recursion on dictionaries of tuples."""
    levels = {L.ORDER: dict(zip(grams, counts))}
    for o in range(L.ORDER - 1, 0, -1):
        c = defaultdict(int)
        for g in levels[o + 1]:
            c[g[1:]] += 1
        levels[o] = dict(c)

    def prob(g):
        o = len(g)
        if o == 0:
            return 2.0 ** -L.BITS
        c = levels[o]
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(max(once / (once + 2 * twice), 0.1), 0.9) if once + twice else 0.5
        after = [v for k, v in c.items() if k[:-1] == g[:-1]]
        if not after:
            return prob(g[1:])
        return max(c.get(g, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * prob(g[1:])

    return prob


def test_model_equals_textbook():
    rnd = random.Random(3)
    grams = list({tuple(rnd.randrange(5) for _ in range(L.ORDER)) for _ in range(150)})
    counts = [rnd.choice([1, 1, 1, 2, 2, 5, 9]) for _ in grams]
    pack = lambda g: sum(s << L.BITS * (len(g) - 1 - i) for i, s in enumerate(g))
    model, prob = L.kneser_ney(*L._merged([(np.array([pack(g) for g in grams]), np.array(counts))])), slow_kneser(grams, counts)
    tests = grams + [tuple(rnd.randrange(7) for _ in range(L.ORDER)) for _ in range(200)]
    got = model.log_prob(np.array([pack(g) for g in tests]))
    assert got == pytest.approx([math.log2(prob(g)) for g in tests])
    every = np.arange(1 << L.BITS)
    for g in tests[:20]:
        assert (2 ** model.log_prob((pack(g) >> L.BITS << L.BITS) + every)).sum() == pytest.approx(1)


def test_held_out_accuracy(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.predict(docs, L.learn(docs)).withColumn("fold", L.fold()).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["fold"] == zlib.crc32(str(r["doc_id"]).encode()) % 4 and 0 <= r["score"] <= 1
    held = [r for r in got if r["fold"] == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in held]) < 0.05


def test_labels_of_held_out_rows_change_nothing(llm):
    from pyspark.sql import functions as F

    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lied = docs.withColumn("lang", F.when(L.fold() == 2, F.lit("xx")).otherwise(F.col("lang")))
    lied = lied.withColumn("source", F.lit("zz"))
    a, b = (sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in L.predict(d.drop("lang", "source"), L.learn(d)).collect()) for d in (docs, lied))
    assert a == b


def test_odd_rows(llm, odd_docs, no_docs):
    model = L.learn(odd_docs)
    rows = L.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        some = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "en") == some and (r["lang_pred"] == "und") == (not some)
    none = L.learn(no_docs)
    assert L.predict(no_docs, none).collect() == []
    assert {r["lang_pred"] for r in L.predict(odd_docs, none).collect()} == {"und"}


def test_every_letter_keeps_its_own_symbols():
    """All letters of Unicode, more than there are symbols, and some of them between others."""
    every = np.unique(L._lower_letters())[1:]
    ranked = np.random.default_rng(1).permutation(every)
    alphabet, rare = L.split_letters(ranked)
    assert len(every) > L.LETTERS and len(alphabet) <= L.LETTERS and len(rare)
    code, at = L.packed(every, np.arange(len(every) + 1), alphabet, rare)
    assert len({tuple(code[a:b].tolist()) for a, b in zip(at, at[1:])}) == len(every)
    low = np.concatenate([rare[:2], alphabet[:1], rare[:1]])
    code, at = L.packed(low, np.array([0, 3, 4]), alphabet, rare)
    last = alphabet[(code & L.U64(L.LETTERS + 1)).astype(int) - 1].tolist()
    h, k = L.HALF, L.HALF + L.HALVES
    assert last[:5] == [h, k, h, k + 1, alphabet[0]] and last[6:8] == [h, k] and at.tolist() == [0, 6, 9]


def test_small_languages_in_another_script_keep_their_letters(llm):
    """Two Cyrillic languages of the same word lengths beside a dominant corpus of over 62 Latin letters."""
    rnd = random.Random(5)
    latin = [chr(c) for c in range(0x61, 0x180) if chr(c).isalpha() and chr(c).lower() == chr(c)]
    assert len(latin) >= 80
    texts = [("la", latin[:80])] * 600 + [("uk", "абвгдеєжзиії")] * 25 + [("bg", "клмнопрстуфх")] * 25
    rows = [(i, " ".join("".join(rnd.choice(of) for _ in range(6)) for _ in range(12)), lang) for i, (lang, of) in enumerate(texts)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs)
    assert set(map(ord, "абвгдеєжзиіїклмнопрстуфх")) <= set(model.alphabet.tolist())
    got = L.predict(docs, model).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] == r["lang"] for r in got)
