"""Physical-plan shape: the scale properties the operators are written for."""

from wattframe.operators import profile, resolve, sampling
from wattframe.plans import standins as S

from conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_duplicate_matrix_single_exchange(spark):
    ev = S.events_long(spark, SF)
    p = plan(profile.duplicate_matrix(ev, "hour", "entity", S.EVENT_ENTITIES))
    assert p.count("Exchange") == 1 and "SortMergeJoin" not in p and "BroadcastHashJoin" not in p


def test_selector_uses_no_window(spark):
    ev = S.events_long(spark, SF)
    sel = resolve.select_predicted(ev, "slot", "cls", "cls_id", "pred_cls", S.BAND_MIN_ID, "event_id", entity="entity")
    assert "Window" not in plan(sel)


def test_merge_carries_no_rows_through_an_aggregation(spark):
    ev = S.events_long(spark, SF)
    p = plan(resolve.merge_resolved(ev, ev.filter("event_id % 7 = 0"), "slot", "entity"))
    assert "SortAggregate" not in p and "ObjectHashAggregate" not in p and "LeftAnti" in p


def test_balanced_sample_limits_before_shuffle(spark):
    ev = S.events_long(spark, SF).select("event_id", "cls")
    p = plan(sampling.balanced_sample(ev, "cls", 150, ["event_id"]))
    assert p.count("WindowGroupLimit") >= 3 and p.count("Exchange") == 2  # per bucket, then per class


def test_scan_prunes_columns(spark):
    from wattframe.sources.files import read_table
    df = read_table(spark, SF, "lineitem").select("l_quantity")
    read = plan(df).split("ReadSchema: struct<")[1].split(">")[0]
    assert [c.split(":")[0] for c in read.split(",")] == ["l_quantity"]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "all_dupl" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_year_split_pushes_range_to_scan(spark):
    from wattframe.sources.files import read_table
    li = read_table(spark, SF, "lineitem", ["l_orderkey", "l_shipdate"])
    _, test = sampling.year_split(li, "l_shipdate", 2000)
    p = plan(test)
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_shipdate" in p


def test_wide_pivot_single_exchange_no_join(spark):
    from wattframe.operators import reshape
    ev = S.events_long(spark, SF).select("slot", "entity", "value")
    p = plan(reshape.to_wide(ev, "slot", "entity", S.EVENT_ENTITIES, ["value"]))
    assert p.count("Exchange") == 1 and "Join" not in p



def test_sequence_blocks_single_exchange(spark):
    from wattframe.operators import sequences
    df = spark.range(0, 500).selectExpr("id AS idx", "CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y")
    p = plan(sequences.build_sequences(df, "idx", "x", "y", history=24, block_size=128))
    assert p.count("Exchange hashpartitioning") == 1 and "Join" not in p
