"""Substring dedup against a count of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from wattframe.llm import substring as S

from .conftest import SF


def slow(rows, window):
    """Expected (doc_id, n_words, n_removed, kept_sha256, kept words) of every row."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


def check(docs, **how):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = slow(rows, how.get("window", S.WINDOW))
    got = S.without_repeats(docs, **how).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in got) == sorted(str(w[:4]) for w in want)
    clean = sorted((str(r["doc_id"]), re.findall(r"[^\x20\x09-\x0D]+", r["clean_text"] or "")) for r in got)
    assert clean == sorted((str(w[0]), w[4]) for w in want)
    same = [r for r in got if r["n_removed"] == 0]
    assert all(r["clean_text"] == r["text"] for r in same)
    return want


@pytest.mark.parametrize("group", [S.GROUP, 1])
def test_whole_table_equals_brute_force(llm, group):
    """With group=1 every repeated anchor is split down to whole windows, with the default none is."""
    want = check(llm.read.parquet(f"{SF}/documents.parquet"), group=group)
    assert sum(w[2] for w in want) > 0


@pytest.mark.parametrize("window", [35, 10, 5, 50])
def test_few_words_many_repeats(llm, window):
    rnd = random.Random(window)
    rows = [(i, "  \n".join(rnd.choice("ab") for _ in range(rnd.randrange(120)))) for i in range(30)]
    rows += [(100, "same " * 200), (101, "same " * 40), (102, "same " * 34), (103, "x " + "same " * 36)]
    check(llm.createDataFrame(rows, "doc_id long, text string"), window=window)


def test_near_copies_and_shared_passages(llm):
    rnd = random.Random(9)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    passage, text = fresh(50), fresh(300)
    rows = [(i, " ".join(fresh(rnd.randrange(60)) + passage + fresh(rnd.randrange(60)))) for i in range(25)]
    for i in range(25):  # near copies: some words changed
        t = list(text)
        for _ in range(3):
            t[rnd.randrange(300)] = fresh(1)[0]
        rows.append((50 + i, " ".join(t)))
    check(llm.createDataFrame(rows, "doc_id long, text string"))
    check(llm.createDataFrame(rows, "doc_id long, text string"), group=7)


def test_one_passage_in_ten_thousand_texts(llm):
    """Its anchors have 10,000 occurrences and, at its edges, as many distinct contexts."""
    rnd = random.Random(3)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    passage = fresh(60)
    rows = [(i, " ".join(fresh(5) + passage[:60 - i % 3] + fresh(20))) for i in range(10_000)]
    assert all(w[2] >= 58 for w in check(llm.createDataFrame(rows, "doc_id long, text string").repartition(16)))


def test_groups_split_at_every_prefix_length(llm):
    """Texts that part after 6, 8, 12, 17, 25 and 34 words, many of each, below and above the limit of a group."""
    rnd = random.Random(5)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    trunk = fresh(80)
    rows = [(100 * k + i, " ".join(trunk[:k] + fresh(2) + fresh(60))) for k in (6, 8, 12, 17, 25, 34, 35, 36, 50) for i in range(12)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    assert S.prefix_steps(35) == [9, 14, 21, 32, 35]
    for group in (1, 5, 40):
        check(docs, group=group)


def test_text_longer_than_a_slice(llm):
    """A text of over 4 MB, whose end repeats in another document."""
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(10**9)}" for _ in range(420_000)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[-40:])), (3, " ".join(words[:34]))]
    want = check(llm.createDataFrame(rows, "doc_id long, text string"))
    assert [w[2] for w in want] == [40, 40, 0]


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert {"lang", "source", "kept"} <= set(S.without_repeats(odd_docs).columns)
    assert S.without_repeats(no_docs).collect() == []
