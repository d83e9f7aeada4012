"""Three-case selector, merge and survivor checks against a brute-force window evaluation."""

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wattframe.operators.resolve import merge_resolved, select_predicted, survivors_check

ID_MAP = {"clear": 800, "clouds": 801, "rain": 500, "snow": 600, "thunderstorm": 200}
SCHEMA = "rid long, hour string, city string, cls string, wid double, pred string"


def brute(rows, rule="running"):
    """Row-by-row evaluation of the window definition (nulls first, ties by rid): sorted (row, flag) pairs.

    Exact copies are rows of their own; rows that share an id but differ are ordered by position here, so
    only inputs without such rows have one right answer.
    """
    by_h, by_hc, out = defaultdict(list), defaultdict(list), []
    for r in rows:
        rid, hour, city, cls, wid, pred = r
        pmin = ID_MAP.get(pred) if pred is not None else None
        diff = None if (wid is None or pmin is None) else wid - pmin
        d = dict(row=r, rid=rid, h=(hour, city), c=cls, wid=wid, pred=pred, diff=diff)
        by_h[d["h"]].append(d)
        by_hc[(d["h"], cls)].append(d)
        out.append(d)
    okey = lambda d: (d["diff"] is not None, d["diff"] if d["diff"] is not None else 0)
    for grp in by_hc.values():
        grp.sort(key=lambda d: (okey(d), d["rid"]))
        for i, d in enumerate(grp):
            d["rn"] = i + 1
            if rule == "running":
                d["cnt"] = sum(1 for e in grp if okey(e) <= okey(d) and e["c"] is not None)
            else:
                d["cnt"] = sum(1 for e in grp if e["c"] is not None)
    for grp in by_h.values():
        ids = [d["wid"] for d in grp if d["wid"] is not None]
        mn = min(ids) if ids else None
        for d in grp:
            d["sc1"] = int(d["pred"] is not None and d["c"] is not None and d["pred"] == d["c"] and d["cnt"] == 1)
            d["sc2"] = int(d["diff"] is not None and d["diff"] == 0 and d["rn"] == 1 and d["sc1"] == 0)
        s12 = sum(d["sc1"] + d["sc2"] for d in grp)
        for d in grp:
            d["sc3"] = int(d["wid"] is not None and mn is not None and d["wid"] == mn and s12 == 0 and d["rn"] == 1)
            d["flag"] = d["sc1"] + d["sc2"] + d["sc3"]
    return sorted(((d["row"], d["flag"]) for d in out), key=str)


def run(spark, rows, rule="running"):
    df = spark.createDataFrame(rows, SCHEMA)
    sel = select_predicted(df, "hour", "cls", "wid", "pred", ID_MAP, "rid", entity="city", rule=rule)
    return sorted(((tuple(r)[:-1], r["select_flag"]) for r in sel.collect()), key=str)


def kept(flags):
    return sorted(row[0] for row, flag in flags if flag == 1)


def test_same_class_same_id_keeps_one(spark):
    rows = [(1, "h", "A", "rain", 500.0, "rain"), (2, "h", "A", "rain", 500.0, "rain")]
    assert kept(run(spark, rows)) == [1]


def test_smallest_not_first_keeps_none(spark):
    rows = [(1, "h", "A", "rain", 500.0, "thunderstorm"), (2, "h", "A", "rain", 501.0, "snow")]
    flags = run(spark, rows)
    assert kept(flags) == [] and flags == brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    sel = select_predicted(df, "hour", "cls", "wid", "pred", ID_MAP, "rid", entity="city")
    assert survivors_check(sel, "hour", "city").count() == 1


def test_prediction_equals_one_class(spark):
    rows = [(1, "h", "A", "rain", 500.0, "clouds"), (2, "h", "A", "clouds", 801.0, "clouds")]
    assert kept(run(spark, rows)) == [2]


def test_prediction_equals_neither_smallest_id(spark):
    rows = [(1, "h", "A", "rain", 500.0, "snow"), (2, "h", "A", "clouds", 801.0, "snow")]
    assert kept(run(spark, rows)) == [1]


def test_each_row_predicts_own_class_keeps_both(spark):
    rows = [(1, "h", "A", "rain", 500.0, "rain"), (2, "h", "A", "clouds", 801.0, "clouds")]
    assert kept(run(spark, rows)) == [1, 2]


def test_prediction_missing_from_map(spark):
    neither = [(1, "h", "A", "rain", 500.0, "fog"), (2, "h", "A", "clouds", 801.0, "fog")]
    assert kept(run(spark, neither)) == [1]
    one = [(1, "h", "A", "rain", 500.0, "rain"), (2, "h", "A", "dust", 731.0, "dust")]
    flags = run(spark, one)
    assert flags == brute(one) and 2 in kept(flags)


def test_exact_copies_are_peers(spark):
    """Two equal clear rows are no single row of their class: the rain row with the smallest id stays."""
    rows = [(1, "h", "A", "clear", 801.0, "clear"), (1, "h", "A", "clear", 801.0, "clear"), (2, "h", "A", "rain", 500.0, "clear")]
    assert run(spark, rows) == brute(rows) and kept(run(spark, rows)) == [2]


def test_rows_that_share_an_id_keep_one(spark):
    rows = [(1, "h", "A", "clear", 800.0, "clear"), (1, "h", "A", "clear", 800.0, "clear")]
    assert [f for _, f in run(spark, rows)] == [0, 1]
    differ = [(1, "h", "A", "clear", 800.0, "clear"), (1, "h", "A", "clear", 800.0, "fog")]
    assert sum(f for _, f in run(spark, differ)) == 1


row_st = st.tuples(st.sampled_from(["h1", "h2"]), st.sampled_from(["A", "B"]),
                   st.sampled_from(["rain", "clouds", "snow", None]),
                   st.sampled_from([500.0, 501.0, 600.0, 801.0, 802.0, None]),
                   st.sampled_from(["rain", "clouds", "snow", "fog", None]))


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row_st, min_size=1, max_size=9), st.lists(st.integers(0, 8), max_size=5), st.sampled_from(["running", "group_size"]))
def test_matches_window_definition(spark, raw, again, rule):
    """Any rows, some of them repeated exactly."""
    rows = [(i,) + r for i, r in enumerate(raw)]
    rows += [rows[i] for i in again if i < len(rows)]
    assert run(spark, rows, rule) == brute(rows, rule)


def test_merge_prefers_resolved_and_keeps_unique(spark):
    orig = spark.createDataFrame([(1, "h1", "A", 1.0), (2, "h2", "A", 2.0), (3, "h2", "A", 3.0), (4, "h3", "A", 4.0),
                                  (5, "h3", "A", 5.0)], "rid long, hour string, city string, v double")
    resolved = orig.filter("rid = 3")
    out = sorted(r["rid"] for r in merge_resolved(orig, resolved, "hour", "city").collect())
    # h1 unique -> kept; h2 resolved -> only the resolved row; h3 repeated, unresolved -> dropped
    assert out == [1, 3]
