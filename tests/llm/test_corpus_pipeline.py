"""The pipeline, stage by stage, against brute force on each stage's own input."""

import re

import pytest

import corpus_pipeline as C
from wattframe.llm import quality as Q
from wattframe.llm.scratch import written

from .conftest import SF
from .test_packing import JSON, Tokenizer
from .test_pii import slow as slow_spans
from .test_simhash import slow_components, slow_fingerprint
from .test_substring import slow as slow_windows


@pytest.fixture(scope="module")
def steps(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        docs, _ = written(stage(llm, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(steps):
    assert [n for n, _ in C.STAGES] == ["quality", "simhash", "substring", "pii", "packing"]
    assert all(d.columns == steps[0].columns for d in steps[1:-1])


def test_quality_rejects_what_the_rules_reject(llm, steps):
    model = Q.fit(steps[0].select("doc_id", "text"), llm.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in Q.score(steps[0], model).filter("kept").collect()}
    got = rows(steps[1])
    assert set(got) == want and 0 < len(want) < steps[0].count()
    before = rows(steps[0])
    assert all(got[i] == before[i] for i in got)


def test_one_of_each_group_stays(steps):
    before = rows(steps[1])
    ids = sorted(before)
    component = slow_components(ids, [slow_fingerprint(before[i]["text"]) for i in ids])
    got = rows(steps[2])
    assert sorted(got) == sorted(set(component)) and all(got[i] == before[i] for i in got)


def test_repeated_passages_go(steps):
    before, got = rows(steps[2]), rows(steps[3])
    want = {w[0]: w[4] for w in slow_windows([(i, r["text"]) for i, r in before.items()], 35)}
    assert {i: re.findall(r"[^\x20\x09-\x0D]+", r["text"]) for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) and r["lang"] == before[i]["lang"] for i, r in got.items())


def test_personal_data_goes(steps):
    before, got = rows(steps[3]), rows(steps[4])
    assert set(got) == set(before)
    for i, r in got.items():
        text, at, out = before[i]["text"], 0, []
        for a, k, b in slow_spans(text):
            if a >= at:
                out += [text[at:a], "<" + ["EMAIL", "IP", "CARD", "PHONE"][k] + ">"]
            at = max(at, b)
        assert r["text"] == "".join(out) + text[at:] and r["n_chars"] == len(r["text"])


def test_every_token_is_packed_once(steps):
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    pieces = {}
    for r in steps[5].collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    want = {i: tok.encode(r["text"], add_special_tokens=False).ids + [0] for i, r in rows(steps[4]).items()}
    assert {i: [x for _, p in sorted(ps) for x in p] for i, ps in pieces.items()} == want


def test_run_equals_the_stages(llm, steps):
    key = lambda df: sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in df.collect())
    assert key(C.run(llm, SF)) == key(steps[5])


def test_odd_rows(llm, odd_docs, no_docs, tmp_path):
    llm.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        columns = docs.columns
        for name, stage in C.STAGES:
            docs, _ = written(stage(llm, docs, str(tmp_path)), f"odd-{name}")
            assert name == "packing" or docs.columns == columns
