"""Personal data: base spans against plain regular expressions, and the bootstrapped patterns on a planted fixture."""

import hashlib
import random
import re

import pytest

from wattframe.llm import pii as I

from .conftest import ODD_TEXTS, SF

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (2 if i % 2 else 1)
        s += x // 10 + x % 10
    return s % 10 == 0


def slow(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def strange(n):
    rnd = random.Random(n)
    bits = ["a@b.c", "x", "@", ".", "1", "255", "256", ".1", " ", "-", "+", "4111 1111 1111 1111", "+1 (555) 123-4567", "é", "%", "(", "\n",
            "0.0.0.0", "00000255", "4111", "@d.e-f"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(n)]


def test_base_spans_equal_plain_patterns():
    for t in strange(20000) + [t or "" for t in ODD_TEXTS]:
        assert I.base_spans(t) == slow(t), t


def test_report_on_whole_table(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = I.report(docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        base = [f"{I.KINDS[k]}:{a}:{b}" for a, k, b in slow(text[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(b.startswith(k + ":") for b in base) for k in I.KINDS]
        assert set(base) <= set(r["spans"].split(",")) | {""}


def planted(llm):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(40):
        rows.append((i, f"{word()} please write to user{i}@mail{i}.example.com today {word()}"))
        rows.append((100 + i, f"{word()} hotline number +1 555 01{i:02d} 4{i:03d} {word()} {word()}"))
        rows.append((200 + i, f"{word()} the value {i * 37} was seen {word()}"))
    rows += [(300, "please write to admin@localhost today"), (301, "our hotline number 555 0199 4321 is open"),
             (302, "the value 5550199432 was seen"), (303, f"{word()} 555 0199 4329 {word()}"), (304, "please write to 77 people")]
    return llm.createDataFrame(rows, "doc_id long, text string")


def test_patterns_find_unseen_identifiers(llm):
    docs = planted(llm)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    extra = {}
    for r in I.identifiers(docs).collect():
        extra[r["doc_id"]] = [(I.KINDS[s["kind"]], text[r["doc_id"]][s["start"]:s["end"]]) for s in r["spans"] if s not in r["base"]]
    assert extra[300] == [("email", "admin@localhost")] and extra[301] == [("phone", "555 0199 4321")]
    assert not any(v for k, v in extra.items() if k not in (300, 301))


def test_scores_equal_plain_iteration(llm):
    """The Spark rounds against the same rounds on Python dictionaries."""
    rnd = random.Random(8)
    edges = {(f"p{rnd.randrange(12)}", f"i{(i := rnd.randrange(90))}", (i % 2 if i < 50 else -1)) for _ in range(700)}
    got = {(r["pattern"], r["kind"]): r["confidence"] for r in
           I.kept_patterns(llm.createDataFrame(list(edges), "pattern string, instance string, kind int"), 3, 0.2, 3).collect()}
    pairs = {(p, i) for p, i, _ in edges}
    seeds = {(i, k): 1.0 for _, i, k in edges if k >= 0}
    score = dict(seeds)
    for _ in range(3):
        kept = {}
        for p in {p for p, _ in pairs}:
            mine = [i for q, i in pairs if q == p]
            for k in (0, 1):
                s = [score[i, k] for i in mine if (i, k) in score]
                c = sum(s) / (len(mine) + I.SMOOTHING)
                if sum(x >= 0.5 for x in s) >= 3 and c >= 0.2 and len(mine) >= 3:
                    kept[p, k] = c
        score = dict(seeds)
        for i in {i for _, i in pairs} - {i for i, _ in seeds}:
            for k in (0, 1):
                miss = [1 - min(kept[p, k], 0.99) for p, j in pairs if j == i and (p, k) in kept]
                if miss:
                    x = 1.0
                    for m in miss:
                        x *= m
                    score[i, k] = 1 - x
    assert got.keys() == kept.keys() and all(got[k] == pytest.approx(v) for k, v in kept.items())


def chain(generations):
    """Edges of patterns that each know a generation of instances and lead to a tenth of the next one."""
    out = []
    for g in range(generations):
        for j in range(20):
            out += [(f"p{g}.{j}", f"i{g}.{x}", 3 if g == 0 else -1) for x in range(60)]
            out += [(f"p{g}.{j}", f"i{g + 1}.{x}", -1) for x in range(6 * (j % 10), 6 * (j % 10) + 6)]
    return out


def test_rounds_go_on_until_nothing_is_found(llm):
    edges = llm.createDataFrame(chain(7), "pattern string, instance string, kind int")
    kept = {(r["pattern"], r["kind"]) for r in I.kept_patterns(edges).collect()}
    assert kept == {(f"p{g}.{j}", 3) for g in range(7) for j in range(20)}
    assert {r["pattern"][:2] for r in I.kept_patterns(edges, 3).collect()} == {"p0", "p1", "p2"}
    assert I.kept_patterns(edges.filter("kind < 0")).collect() == []


def test_fifth_generation_in_texts(llm):
    """Numbers known only through four others: each context names 60 numbers, some of them new, after the one before."""
    rows = []
    number = lambda g, x: f"+1 555 {g}{x:03d} 4{x:03d}" if g == 0 else f"555{g}{x:03d}4{x:03d}"
    for g in range(5):
        for j in range(20):
            for n in [number(g, x) for x in range(60)] + [number(g + 1, x) for x in range(6 * (j % 10), 6 * (j % 10) + 6)]:
                rows.append((len(rows), f"{'abcdefghijklmnopqrst'[j] * (g + 2)}:{n}"))
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    found = {text[r["doc_id"]][s["start"]:s["end"]] for r in I.identifiers(docs).collect() for s in r["spans"] if s["kind"] == 3}
    assert found == {number(g, x) for g in range(6) for x in range(60)}


def test_cut_at_colon_and_equals():
    seen = lambda t: [(t[a:b], shape) for a, b, _, shape, _, _ in I.occurrences(t, I.base_spans(t))]
    assert seen("phone:5551234567") == seen("tel=5551234567") == [("5551234567", 8)]
    assert seen("call phone:555 0199 4321 now") == [("555 0199 4321", 8)]
    assert seen("mailto:bob@localhost") == [("bob@localhost", 1)] and seen("at 12:30 a=b") == [("12", 0), ("30", 0)]
    assert seen("(555) 0199 4321") == [("(555) 0199 4321", 8)]
    assert I.occurrences("Phone: 5551234567", [])[0][5][1] == "phone _" and I.occurrences("Phone:5551234567", [])[0][5][1] == "phone: _"


def test_long_context_words_stay_apart():
    one, two = ("x" * 50 + "end", "y" * 50 + "x" * 37 + "end")
    assert I.occurrences(f"{one} 5551234567", [])[0][5] != I.occurrences(f"{two} 5551234567", [])[0][5]
    assert I.occurrences(f"5551234567 {one}", [])[0][5] != I.occurrences(f"5551234567 {two}", [])[0][5]


def test_text_longer_than_a_slice(llm):
    text = "filler " * 700_000 + "write to someone@example.com"
    got = I.report(llm.createDataFrame([(1, text), (None, None)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["spans"]) for r in got} == {(1, f"email:{len(text) - 19}:{len(text)}"), (None, "")}


def test_redaction(llm, odd_docs, no_docs):
    docs = planted(llm).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("en"))
    got = {r["doc_id"]: r["text"] for r in I.redact(docs).collect()}
    assert got[300] == "please write to <EMAIL> today" and got[301] == "our hotline number <PHONE> is open"
    assert "<EMAIL>" in got[3] and "@" not in got[3] and got[302] == "the value 5550199432 was seen"
    odd = I.redact(odd_docs)
    assert odd.columns == odd_docs.columns
    assert sorted(str(r) for r in odd.collect()) == sorted(str(r) for r in odd_docs.collect())
    assert I.redact(no_docs).collect() == [] and I.report(no_docs).collect() == []
    assert len(I.report(odd_docs).collect()) == odd_docs.count()


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for t in ("1" * 200_000, "a" * 200_000 + "@", "+1" * 100_000, "a@b" * 60_000, "1.2.3." * 40_000, "+1((((" * 30_000, "a1:" * 60_000 + " " + "z" * 200_000):
        I.occurrences(t, I.base_spans(t))
    assert time.time() - began < 20
