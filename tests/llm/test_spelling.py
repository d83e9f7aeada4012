"""Spelling variants against all pairs of words compared one by one; counts against plain Python; odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from wattframe.llm import spelling as S

from .conftest import SF

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def slow(counts):
    """word -> (form, root, n, n_near, form_n); words of one length or the next are compared."""
    words = sorted(counts)
    near = {w: [] for w in words}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for size, group in by_size.items():
        for i, a in enumerate(group):
            for b in group[i + 1:] + by_size.get(size + 1, []):
                # one edit leaves the first or the second half alone
                if (a[:len(a) // 2] == b[:len(a) // 2] or a[-(len(a) // 2):] == b[-(len(a) // 2):]) and one_edit(a, b):
                    near[a].append(b)
                    near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def words_of(rows):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def result(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_on_whole_table(llm):
    from wattframe.llm.queries import QUERIES
    rows = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SF}/documents.parquet").collect()]
    got = result(QUERIES["op11_spelling"](llm, SF))
    want = slow(words_of(rows))
    assert got == want and any(f for f, *_ in want.values()) and any(n > 1 for _, _, _, n, _ in want.values())


@pytest.mark.parametrize("letters", ["ab", "abc", "aéÿ"])
def test_dense_words_ties_and_chains(llm, letters):
    rnd = random.Random(len(letters))
    counts = {}
    for _ in range(250):
        word = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9)))
        counts[word] = 2 ** rnd.randrange(9)
    df = llm.createDataFrame([(w, n, 1) for w, n in counts.items()] + [(None, 5, 1)], "word string, n int, root int")
    assert result(S.group_variants(df)) == slow(counts)


def test_long_words_around_the_hash(llm):
    rnd = random.Random(3)
    counts = {}
    for size in (62, 63, 64, 65, 66, 700):
        base = "".join(rnd.choice("abc") for _ in range(size))
        counts[base] = 100
        for _ in range(6):
            i = rnd.randrange(size)
            counts[base[:i] + base[i + 1:]] = rnd.randrange(1, 60)
            counts[base[:i] + "d" + base[i + 1:]] = rnd.randrange(1, 60)
            counts[base[:i] + "e" + base[i:]] = rnd.randrange(1, 60)
    assert result(S.group_variants(llm.createDataFrame(list(counts.items()), "word string, n long"))) == slow(counts)


def test_very_long_text_and_word(llm):
    long = "z" * 40_000
    texts = [(1, f"{long} " * 3 + long[1:] + " " + (long[1:] + ". ") * 6), (2, "Straße straße STRASSE " * 200_000), (None, "Straße " * 3)]
    got = result(S.spelling_variants(llm.createDataFrame(texts, "doc_id long, text string")))
    want = words_of(texts)
    assert {w: v[2] for w, v in got.items()} == want
    assert got[long][:2] == (long[1:], long[1:]) if want.get(long[1:], 0) >= 2 * want[long] else True


def test_odd_rows_and_empty_table(llm, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert result(S.spelling_variants(odd_docs)) == slow(words_of(rows))
    assert S.spelling_variants(no_docs).count() == 0
    with pytest.raises(ValueError):
        S.group_variants(no_docs.selectExpr("text as word", "doc_id as n"), 1)
