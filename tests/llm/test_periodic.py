"""Periodic runs against a plain search over all periods; the repeated ends; odd rows; long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import periodic as P

from .conftest import ODD_TEXTS, SF


def slow(words, least=12):
    """Every maximal stretch of every period, the smallest period of equal stretches."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n_, q) for (s, n_), q in found.items())


def fast(texts):
    distinct = {}
    codes = np.array([distinct.setdefault(w, len(distinct)) for t in texts for w in t], np.int64)
    words = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    s, n, p = P.runs(codes, words)
    out = [[] for _ in texts]
    for a, b, c in zip(s.tolist(), n.tolist(), p.tolist()):
        d = int(np.searchsorted(words, a, side="right") - 1)
        out[d].append((a - int(words[d]), b, c))
    return out


def check(texts):
    for t, got in zip(texts, fast(texts)):
        assert got == slow(t), t


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_words_of_few_letters(letters):
    rnd = random.Random(letters)
    check([[rnd.choice("abcde"[:letters]) for _ in range(rnd.randrange(160))] for _ in range(250)])


def test_powers_with_damage():
    rnd = random.Random(9)
    texts = []
    for _ in range(400):
        unit = [rnd.choice("abc") for _ in range(rnd.randrange(1, 45))]
        unit = unit * rnd.randrange(1, 4) + unit[:rnd.randrange(len(unit) + 1)]
        text = [rnd.choice("xyz") for _ in range(rnd.randrange(8))] + unit * rnd.randrange(2, 6) + unit[:rnd.randrange(len(unit))]
        for _ in range(rnd.randrange(3)):
            text[rnd.randrange(len(text))] = rnd.choice("abcx")
        texts.append(text + [rnd.choice("ab") for _ in range(rnd.randrange(9))])
    check(texts)


def test_fibonacci_and_chains():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    check([list(b), list("ab" * 9 + "a" + "a" + "ba" * 9), list(("ab" * 7 + "c") * 5), list(("aab" * 11 + "a") * 4), list("a" * 500)])


def test_seeds_grow_with_words():
    for unit in ("a", "ab", "aab"):
        codes = np.array([ord(c) for c in unit * (60_000 // len(unit))], np.int64)
        assert len(P.seeds(codes, np.array([0, len(codes)]))[0]) < len(codes)


def echo(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if i is None or n == 0:
        return words
    h = zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (k - a) % p] for k in range(a, n)]


def expected(words, found):
    keep = [True] * len(words)
    for s, n, q in found:
        keep[s + q:s + n] = [False] * (n - q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for w, k in zip(words, keep) if k)))


def test_query_on_whole_table(llm):
    from wattframe.llm.queries import QUERIES
    text = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_periodic"](llm, SF).collect()
    assert len(rows) == len(text)
    periodic = 0
    for r in rows:
        words = echo(r["doc_id"], text[r["doc_id"]])
        assert tuple(r[1:]) == expected(words, slow(words) if len(words) < 1500 else fast([words])[0])
        periodic += r["n_runs"] > 0
    assert periodic > 5


def test_odd_rows_clashing_columns_and_empty_table(odd_docs, no_docs):
    from collections import Counter
    docs = odd_docs.withColumn("text", P.echoed(F.col("doc_id"), F.col("text")))
    out = P.periodic_runs(docs)
    assert Counter(out.columns).most_common(1)[0][1] == 1 and out.count() == odd_docs.count()
    for r in out.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == expected(words, slow(words))
        assert len(r["runs"]) == r["n_runs"] and (r["collapsed_text"] is None) == (r["text"] is None)
    assert P.periodic_runs(no_docs).count() == 0


def test_texts_longer_than_a_slice(llm):
    texts = ["tick " * 500_000, " ".join(map(str, range(400_000))) + " x y" * 100_000, ("a " * 20 + "b ") * 30_000]
    docs = llm.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = {r["id"]: r for r in P.periodic_runs(docs, with_text=False).collect()}
    assert (rows[0]["start"], rows[0]["length"], rows[0]["period"], rows[0]["n_runs"]) == (0, 500_000, 1, 1)
    assert (rows[1]["start"], rows[1]["length"], rows[1]["period"], rows[1]["n_runs"]) == (400_000, 200_000, 2, 1)
    assert (rows[2]["start"], rows[2]["length"], rows[2]["period"], rows[2]["n_runs"]) == (0, 630_000, 21, 30_001)


def test_repeated_ends_equal_plain_python(llm):
    docs = llm.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 37)) + " \n") for i in range(300)] + [(None, "a b"), (7, None)], "doc_id long, text string")
    for r in docs.withColumn("new", P.echoed(F.col("doc_id"), F.col("text"))).collect():
        assert re.findall(r"[^\x20\x09-\x0D]+", r["new"] or "") == echo(r["doc_id"], r["text"])
