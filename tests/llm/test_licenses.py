"""License scans against plain containment of every template in every window."""

import random
import re

import duckdb
import pytest

from wattframe.llm import licenses as N

from .conftest import SF


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(w):
    return [" ".join(w[i:i + 5]) for i in range(len(w) - 4)]


def slow(rows, templates=N.TEMPLATES):
    out = set()
    wanted = [(name, kind, set(shingles(words(t)))) for name, kind, t in templates]
    for i, text in set(rows):
        s = shingles(words(text))
        there = set(s)
        for name, kind, want in wanted:
            if not want & there:
                continue
            size = N.window_shingles(len(want))
            shares = {a: len(want & set(s[a:a + size])) / len(want) for a in range(0, max(len(s), 1), size // 2)}
            good = {a: x for a, x in shares.items() if x >= 0.8}
            if good:
                out.add((i, name, kind, max(good.values()), min(good)))
    return out


def check(docs, templates=N.TEMPLATES):
    got = [tuple(r) for r in N.scan(docs, templates).collect()]
    want = slow([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], templates)
    assert sorted(map(str, got)) == sorted(map(str, want))
    return got


def test_whole_table_equals_plain_scan(llm):
    assert check(llm.read.parquet(f"{SF}/documents.parquet"))


def test_sql_gives_the_same(llm):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert {tuple(r) for r in con.execute(N.scan_sql()).fetchall()} == {tuple(r) for r in N.scan(llm.read.parquet(f"{SF}/documents.parquet")).collect()}


def test_whole_and_changed_notices_in_long_texts(llm):
    rnd = random.Random(6)
    noise = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    rows = []
    templates = N.NOTICES + N.common_wordings()[::9]
    for k, (_, _, t) in enumerate(templates):
        for j in range(6):
            w = t.split()
            if j > 2 and len(w) > 40:  # some words changed
                w[len(w) * j // 7] = "changed"
            text = " ".join(w).upper() if j == 2 else "\n * ".join(w)
            rows.append((10 * k + j, f"{noise(rnd.randrange(900))} {text} {noise(rnd.randrange(900))}"))
    found = check(llm.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0] // 10 for r in found} == set(range(len(templates)))


def test_texts_over_two_mebibytes_at_the_borders_of_segments(llm):
    rnd = random.Random(8)
    notice = next(t for t in N.NOTICES if t[0] == "bsd-3-text")
    n = len(words(notice[2]))
    segment = max(N.SEGMENT, 8 * N.window_shingles(n))
    text = [f"w{rnd.randrange(10**7)}" for _ in range(300_000)]
    for k, at in enumerate((segment - n, 2 * segment - n // 2, 3 * segment, 4 * segment - 1, 5 * segment + 1, len(text) - n)):
        text[at:at + n] = words(notice[2])
        text[at + 17 * k] = "changed"
    long_text = " ".join(text)
    assert len(long_text) > 2 << 20
    rows = [(1, long_text), (2, " ".join(text[2 * segment - n:2 * segment + n]))]
    templates = [notice, ("line", "MIT", "Released under the MIT License.")]
    assert {r[0] for r in check(llm.createDataFrame(rows, "doc_id long, text string"), templates)} == {1, 2}
    # every copy by itself, through short texts that hold only one border each
    alone = [(i, " ".join(["x"] * (i * 37) + text[i * segment - 2 * n:i * segment + 2 * n])) for i in range(1, 6)]
    assert {r[0] for r in check(llm.createDataFrame(alone, "doc_id long, text string"), templates)} == set(range(1, 6))


def test_thousands_of_templates(llm):
    rnd = random.Random(9)
    made = [(f"t{k}", "made", " ".join(f"v{rnd.randrange(5000)}" for _ in range(rnd.randrange(5, 40)))) for k in range(3000)]
    rows = [(k, f"a b c {t} d e f") for k, (_, _, t) in enumerate(made[::100])]
    found = check(llm.createDataFrame(rows, "doc_id long, text string"), made)
    assert len(found) == len(rows)


def test_usual_wordings_are_found(llm):
    texts = {"GPL-3.0": "This tool is licensed under the GNU General Public License v3.0 or newer", "BSD-3-Clause": "released under the BSD 3-clause license",
             "CC-BY-SA-4.0": "The text is available under the Creative Commons Attribution-ShareAlike 4.0 International License",
             "Apache-2.0": "SPDX-License-Identifier: Apache-2.0", "MIT": "Code is licensed under the MIT license, see LICENSE"}
    docs = llm.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    assert {list(texts)[r["doc_id"]]: r["license"] for r in N.scan(docs).collect()} == {k: k for k in texts}


def test_band_settings():
    assert (1 - N.least_similarity()) ** N.bands() <= 0.001
    for t in range(1, 300):
        size = N.window_shingles(t)
        assert t <= size / 2 < 2 * t and 0.8 * t / (size + 0.2 * t) >= N.least_similarity()


def test_no_python_in_the_plan(llm):
    plan = N.scan(llm.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_odd_rows(odd_docs, no_docs):
    assert check(odd_docs) == [] and N.scan(no_docs).collect() == [] and N.scan(odd_docs, []).collect() == []
    with pytest.raises(ValueError):
        N.scan(odd_docs, [("x", "x", "too short")])
    with pytest.raises(ValueError):
        N.scan(odd_docs, [("x", "x", "one name for two texts here"), ("x", "x", "another text of five words")])
