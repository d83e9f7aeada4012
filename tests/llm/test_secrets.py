"""Secret scans: the automaton against plain regular expressions, its cuts into lanes, odd rows, long texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from wattframe.llm import secrets as S

from .conftest import ODD_TEXTS, SF

BASE = {"assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
LEAST = {"assign": (2, 8), "access": (0, 16), "hex": (0, 32)}
BITS = ["password", "PASSWD", "token", "api", "_", "key", "secret", "=", ":", " ", "'", '"', "abc", "0123456789abcdef", "AKIA", "AKIA",
        "ABCD1234", "Zz", "\n", "é", "🙂", "deadbeef" * 2, "ghp_", "eyJ", ".", "eyJabc", "https://", "u", "@", "bearer ", "Bearer", "xoxb-",
        "AIza", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "sk_live_", "a1" * 5, "\x00"]


def slow(text):
    out = []
    for k, (name, p) in enumerate(BASE.items()):
        group, least = LEAST[name]
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "") if len(m[group]) >= least]
    for k, rule in enumerate(S.ADDED, len(BASE)):
        pattern = f"(?:{rule.head})(?P<tail>{rule.tail}+)" if rule.tail else rule.head
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "", re.I if rule.any_case else 0)
                if not rule.tail or len(m["tail"]) >= rule.least]
    return sorted(out)


def scanned(texts, rules=S.RULES):
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    found = [[] for _ in raw]
    for d, a, b, r in zip(*(x.tolist() for x in S.find(np.frombuffer(b"".join(raw), np.uint8), offsets, tuple(rules)))):
        o = int(offsets[d])
        found[d].append((len(raw[d][:a - o].decode()), r, len(raw[d][:b - o].decode())))
    return [sorted(f) for f in found]


def test_equal_to_plain_patterns():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(60))) for _ in range(6000)] + ODD_TEXTS
    for text, got in zip(texts, scanned(texts)):
        assert got == slow(text), text


@pytest.mark.parametrize("lanes", [1, 3, 7, 2048])
def test_states_do_not_depend_on_lanes(lanes):
    auto = S.compiled(tuple(S.RULES))[0]
    rnd = random.Random(lanes)
    text = np.frombuffer("".join(rnd.choice(BITS) for _ in range(4000)).encode(), np.uint8)
    symbols = auto.classes[text]
    state, plain = 0, []
    for s in symbols.tolist():
        state = int(auto.moves[state + s])
        plain.append(state)
    assert S.states(auto, symbols, lanes).tolist() == plain


def test_automaton_is_minimal_and_small():
    combined, single = S.compiled(tuple(S.RULES))
    table = combined.moves.reshape(-1, combined.width)[:, :-1] // combined.width
    again, masks = S._minimal(table.astype(np.int64), combined.masks)
    assert len(again) == len(table) < 4000 and masks[0] == 0
    assert all(len(a.masks) < 64 for a in single)


def test_failing_matches_are_not_tried_again():
    # the dropped match takes "secret", so nothing begins inside it
    assert scanned(["token=secret: 0123456789", "token=secret:abcdefgh", "secret=token=abcdefgh"]) == [[], [], [(0, 0, 21)]]


def test_one_secret_over_many_lanes_and_slices(llm):
    texts = ["x" * 300_000 + " token=" + "Ab1" * 900_000 + " end", "f" * 2_500_000, "é" * 1_200_000 + "AKIA" + "Z" * 12, "secret " * 400_000]
    docs = llm.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in S.report(docs).collect()}
    assert got == {0: f"assign:300001:{300007 + 2_700_000}", 1: "hex:0:2500000", 2: "access:1200000:1200016", 3: ""}


def test_report_on_whole_table(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = S.report(docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        names = [f"{S.RULES[k].kind}:{a}:{b}" for a, k, b in slow(text[r["doc_id"]])]
        base = [n for n in names if n.split(":")[0] in BASE]
        assert r["spans"] == ",".join(names) and r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(n.startswith(k + ":") for n in base) for k in BASE]


def test_odd_rows_clashing_columns_and_empty_table(odd_docs, no_docs):
    out = S.spans(odd_docs.withColumnRenamed("fp", "secrets"))
    assert out.count() == odd_docs.count() and out.columns.count("secrets") == 1
    rows = S.report(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r["spans"] for r in rows} == {""}
    assert S.report(no_docs).count() == 0 and S.masked(no_docs).count() == 0
    one_file = no_docs.sparkSession.createDataFrame([(1, None, "en", "s", 0)], no_docs.schema)
    assert S.report(one_file).first()["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_masked_text_and_own_rules(llm):
    docs = llm.createDataFrame([(1, 'é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', 5), (2, "clean", 6), (3, None, 7)],
                               "doc_id long, text string, secrets int")
    rows = {r["doc_id"]: r["text"] for r in S.masked(docs).collect()}
    assert rows == {1: 'é <ASSIGN>" end', 2: "clean", 3: None}
    assert S.masked(docs).columns == ["doc_id", "text", "secrets"]
    rules = [S.Rule("badge", r"B-\d{3}"), S.Rule("run", "", "[xy]", 4)]
    assert scanned(["B-12 B-123 xyx xyxyxy B-4567"], rules) == [[(5, 0, 10), (15, 1, 21), (22, 0, 27)]]


@pytest.mark.parametrize("pattern", ["(a", "[^a]", "a**)", "a{3,2}", "", "a?", "\\q", "é", "[b-a]"])
def test_bad_rules_raise(pattern):
    with pytest.raises(ValueError):
        S.compile_rules([S.Rule("bad", pattern)], True)
