"""

Every query reads the test tables under ``sf_dir`` whole (see ``wattframe.plans.standins`` for how
they play the energy / weather data model) and is built from the library's operators.  Computed
columns carry the same alias on both sides.  Only sums of two-decimal values and square roots are
rounded; means and ratios are left unrounded, because rounding them would create exact decimal
ties that summation order then breaks differently in the two engines.

Sections, in order: duplicates and profiling; selector, merge, wide; sources, catalog, projections;
join, concat, totals, nulls; time parsing, splits, folds; sequences, scaling, label index; metrics
and report tables; the energy ⋈ weather table and the whole flow; classifiers and resolution;
forecasting.  Some queries share their SQL with another on purpose, to check an alternative path
of the same operator: ``selector_aggregation_path`` (hot-group path), ``selector_group_size_rule``,
``wide_pivot_text_fallback``, ``sequence_history_explode``, ``rmse_matrix_long``,
``means_and_std_long``, ``duplicate_matrix_flag_subset``, ``text_repair_plain_chain``.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from wattframe.operators import positions, profile, resolve, reshape, sampling  # noqa: E402
from wattframe.operators.features import calendar_features  # noqa: E402
from wattframe.operators.joins import semi_join  # noqa: E402
from wattframe.plans import standins as S  # noqa: E402
from wattframe.session import configure  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


E = S.EVENT_ENTITIES
EV = f"e AS ({S.EVENTS_LONG_SQL})"


def _case_map(col: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in mapping.items()) + " END"


# --- duplicates and profiling ---------------------------------------------------------------

def _dup_matrix_sql(key: str, flag_entities=None) -> str:
    n = ", ".join(f"count(*) FILTER (WHERE entity = '{x}') AS n_{x}" for x in E)
    counts = ", ".join(f"CAST(CASE WHEN n_{x} >= 2 THEN n_{x} ELSE 0 END AS BIGINT) AS counts_{x}" for x in E)
    anyrep = " OR ".join(f"n_{x} >= 2" for x in E)
    alld = " AND ".join(f"counts_{x} > 0" for x in (flag_entities or E))
    return (f"WITH {EV}, g AS (SELECT {key}, {n} FROM e GROUP BY {key}), "
            f"c AS (SELECT {key}, {counts} FROM g WHERE {anyrep}) SELECT *, ({alld}) AS all_dupl FROM c")


@query("duplicate_matrix", _dup_matrix_sql("hour"))
def q_duplicate_matrix(spark, d):
    return profile.duplicate_matrix(S.events_long(spark, d), "hour", "entity", E)


@query("duplicate_matrix_flag_subset", _dup_matrix_sql("hour", E[:4]))
def q_duplicate_matrix_flag_subset(spark, d):
    """The matrix with ``all_dupl`` over a subset of the entities (the source's four-of-five flag)."""
    return profile.duplicate_matrix(S.events_long(spark, d), "hour", "entity", E, all_entities=E[:4])


@query("count_of_counts", f"""WITH {EV}, k AS (SELECT entity, slot, count(*) AS multiplicity FROM e GROUP BY 1, 2)
SELECT entity, multiplicity, count(*) AS n_keys FROM k GROUP BY 1, 2""")
def q_count_of_counts(spark, d):
    return profile.duplicate_histogram(S.events_long(spark, d), "slot", "entity")


@query("having_duplicates", f"""WITH {EV}
SELECT slot, entity, count(*) AS n_rows FROM e GROUP BY 1, 2 HAVING count(*) >= 2""")
def q_having_duplicates(spark, d):
    return profile.duplicate_counts(S.events_long(spark, d), "slot", "entity")


_DUP_SLOTS = "dk AS (SELECT DISTINCT slot FROM e GROUP BY slot, entity HAVING count(*) >= 2)"


@query("duplicate_profile", f"""WITH {EV}, {_DUP_SLOTS}
SELECT cls, count(*) AS count FROM e WHERE lower(trim(entity)) = 'view'
  AND EXISTS (SELECT 1 FROM dk WHERE dk.slot = e.slot) GROUP BY cls""")
def q_duplicate_profile(spark, d):
    ev = S.events_long(spark, d)
    dm = profile.duplicate_matrix(ev, "slot", "entity", E)
    return profile.duplicate_profile(ev, dm.select("slot"), "slot", "entity", "view", "cls")


@query("anti_clean_hours", f"""WITH {EV}, {_DUP_SLOTS}
SELECT event_id, slot, entity FROM e WHERE NOT EXISTS (SELECT 1 FROM dk WHERE dk.slot = e.slot)""")
def q_anti_clean_hours(spark, d):
    ev = S.events_long(spark, d)
    dm = profile.duplicate_matrix(ev, "slot", "entity", E)
    return semi_join(ev, dm, ["slot"], anti=True).select("event_id", "slot", "entity")


_DUP_KEYS = "dk AS (SELECT slot, entity FROM e GROUP BY slot, entity HAVING count(*) >= 2)"
_DUP_ROWS = f"{_DUP_KEYS}, dr AS (SELECT * FROM e WHERE EXISTS (SELECT 1 FROM dk WHERE dk.slot = e.slot AND dk.entity = e.entity))"


@query("semi_duplicates", f"""WITH {EV}, {_DUP_ROWS} SELECT event_id, slot, entity, value FROM dr""")
def q_semi_duplicates(spark, d):
    ev = S.events_long(spark, d)
    return semi_join(ev, profile.duplicate_counts(ev, "slot", "entity"), ["slot", "entity"]).select(
        "event_id", "slot", "entity", "value")


def _quality_sql() -> str:
    per = ", ".join(f"count(*) FILTER (WHERE entity = '{x}') AS n_{x}" for x in E)
    return f"""WITH {EV}, dm AS ({_dup_matrix_sql('hour')}),
a AS (SELECT count(*) AS n_rows,
  count(*) FILTER (WHERE event_id IS NULL OR hour IS NULL OR entity IS NULL OR value IS NULL OR isnan(value)
                   OR user_id IS NULL) AS n_rows_with_null,
  count(DISTINCT hour) AS n_keys, count(DISTINCT (hour, entity)) AS n_key_entity, {per} FROM e)
SELECT *, n_keys * {len(E)} AS expected_rows, n_rows = n_keys * {len(E)} AS complete,
  (SELECT count(*) FROM dm) AS n_duplicated_keys,
  printf('%.2f%%', (SELECT count(*) FROM dm) / CAST(n_keys AS DOUBLE) * 100) AS duplicated_share FROM a"""


@query("quality_summary", _quality_sql())
def q_quality_summary(spark, d):
    ev = S.events_long(spark, d).select("event_id", "hour", "entity", "value", "user_id")
    dm = profile.duplicate_matrix(ev, "hour", "entity", E)
    return profile.quality_checks(ev, "hour", "entity", E, duplicates=dm)


# --- selector, merge, wide ------------------------------------------------------------------

@query("class_min_id", f"WITH {EV} SELECT cls, min(cls_id) AS min_id FROM e GROUP BY cls")
def q_class_min_id(spark, d):
    return S.events_long(spark, d).groupBy("cls").agg(F.min("cls_id").alias("min_id"))


@query("id_map_lookup", f"""WITH {EV} SELECT event_id, cls, pred_cls, {_case_map('pred_cls', S.BAND_MIN_ID)} AS pred_min_id,
  cls_id - {_case_map('pred_cls', S.BAND_MIN_ID)} AS pred_min_id_diff FROM e""")
def q_id_map_lookup(spark, d):
    m = resolve.id_map_column(S.BAND_MIN_ID)
    return S.events_long(spark, d).select(
        "event_id", "cls", "pred_cls", m[F.col("pred_cls")].alias("pred_min_id"),
        (F.col("cls_id") - m[F.col("pred_cls")]).alias("pred_min_id_diff"))


_UNIF = "md5(concat_ws(':', '42', coalesce(CAST(event_id AS VARCHAR), '')))"


@query("balanced_sample", f"""WITH {EV}, r AS (SELECT event_id, cls, {_UNIF} AS unif,
  CAST(dense_rank() OVER (PARTITION BY cls ORDER BY {_UNIF} DESC, event_id) AS INTEGER) AS cat_rank FROM e)
SELECT * FROM r WHERE cat_rank <= 150""")
def q_balanced_sample(spark, d):
    ev = S.events_long(spark, d).select("event_id", "cls")
    return sampling.balanced_sample(ev, "cls", 150, ["event_id"], seed=42, keep_helpers=True)


@query("hash_split", f"""WITH {EV} SELECT event_id,
  CASE WHEN substr({_UNIF}, 1, 8) < '99999999' THEN 'train' ELSE 'test' END AS split FROM e""")
def q_hash_split(spark, d):
    return S.events_long(spark, d).select("event_id", sampling.split_label(["event_id"], 0.6, 42).alias("split"))


def _selector_sql(final: str, rule: str = "running", rows: str = "dr") -> str:
    pmin = _case_map("pred_cls", S.BAND_MIN_ID)
    count_window = ("PARTITION BY slot, entity, cls ORDER BY diff ASC NULLS FIRST\n"
                    "                   RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW") if rule == "running" \
        else "PARTITION BY slot, entity, cls"
    return f"""WITH {EV}, {_DUP_ROWS},
q AS (SELECT event_id, slot, entity, cls, cls_id, pred_cls, value, cls_id - {pmin} AS diff FROM {rows}),
r AS (SELECT *, row_number() OVER (PARTITION BY slot, entity, cls ORDER BY diff ASC NULLS FIRST, event_id) AS rn,
  min(cls_id) OVER (PARTITION BY slot, entity) AS min3,
  count(cls) OVER ({count_window}) AS cnt FROM q),
s AS (SELECT *, CASE WHEN pred_cls = cls AND cnt = 1 THEN 1 ELSE 0 END AS sc1 FROM r),
t AS (SELECT *, CASE WHEN diff = 0 AND rn = 1 AND sc1 = 0 THEN 1 ELSE 0 END AS sc2 FROM s),
u AS (SELECT *, sum(sc1 + sc2) OVER (PARTITION BY slot, entity) AS s12 FROM t),
sel AS (SELECT event_id, slot, entity, cls, cls_id, pred_cls, value,
  CAST(sc1 + sc2 + CASE WHEN cls_id = min3 AND s12 = 0 AND rn = 1 THEN 1 ELSE 0 END AS INTEGER) AS select_flag
  FROM u)
{final}"""


def _selected(spark, d, rule="running", copies=False):
    ev = S.events_long(spark, d)
    rows = semi_join(ev, profile.duplicate_counts(ev, "slot", "entity"), ["slot", "entity"]).select(
        "event_id", "slot", "entity", "cls", "cls_id", "pred_cls", "value")
    if copies:
        rows = rows.unionAll(rows.filter("event_id % 3 = 0"))
    return ev, resolve.select_predicted(rows, "slot", "cls", "cls_id", "pred_cls", S.BAND_MIN_ID,
                                        row_id="event_id", entity="entity", rule=rule)


@query("selector_three_case", _selector_sql("SELECT * FROM sel"))
def q_selector_three_case(spark, d):
    return _selected(spark, d)[1]


@query("selector_aggregation_path", _selector_sql("SELECT * FROM sel"))
def q_selector_aggregation_path(spark, d):
    """The selector (all groups take the aggregation form)."""
    return _selected(spark, d)[1]


@query("selector_exact_copies", _selector_sql(
    "SELECT * FROM sel", rows="(SELECT * FROM dr UNION ALL SELECT * FROM dr WHERE event_id % 3 = 0) c"))
def q_selector_exact_copies(spark, d):
    """The selector where every third row is there twice: of copies at most the first is kept, all count as peers."""
    return _selected(spark, d, copies=True)[1]


@query("selector_group_size_rule", _selector_sql("SELECT * FROM sel", rule="group_size"))
def q_selector_group_size_rule(spark, d):
    """The selector with case 1 counting the whole class group instead of the running count."""
    return _selected(spark, d, rule="group_size")[1]


@query("merge_resolved", _selector_sql(f"""SELECT event_id, slot, entity, cls, value FROM (
  SELECT *, count(*) OVER (PARTITION BY slot, entity) AS n FROM (
    SELECT event_id, slot, entity, cls, value, 'original' AS dataset FROM e
    UNION ALL SELECT event_id, slot, entity, cls, value, 'predicted' FROM sel WHERE select_flag = 1) x) y
WHERE n = 1 OR (n > 1 AND dataset = 'predicted')"""))
def q_merge_resolved(spark, d):
    ev, sel = _selected(spark, d)
    cols = ["event_id", "slot", "entity", "cls", "value"]
    return resolve.merge_resolved(ev.select(*cols), sel.filter("select_flag = 1").select(*cols), "slot", "entity")


@query("selector_survivors", _selector_sql("""SELECT slot, entity, count(*) FILTER (WHERE select_flag = 1) AS n_kept,
  count(*) AS n_rows FROM sel GROUP BY slot, entity HAVING count(*) FILTER (WHERE select_flag = 1) <> 1"""))
def q_selector_survivors(spark, d):
    return resolve.survivors_check(_selected(spark, d)[1], "slot", "entity")


def _wide_sql() -> str:
    cols = ", ".join(f"min(CASE WHEN entity = '{x}' THEN {m} END) AS {m}_{x}" for x in E for m in ("value", "cls"))
    return f"WITH {EV} SELECT slot, {cols} FROM e GROUP BY slot"


@query("wide_pivot", _wide_sql())
def q_wide_pivot(spark, d):
    ev = S.events_long(spark, d).select("slot", "entity", "value", "cls")
    return reshape.to_wide(ev, "slot", "entity", E, ["value", "cls"], dictionaries={"cls": list(S.BAND_MIN_ID)})


@query("wide_pivot_text_fallback", _wide_sql())
def q_wide_pivot_text_fallback(spark, d):
    """The wide pivot with text measures aggregated as text (no dictionary given)."""
    ev = S.events_long(spark, d).select("slot", "entity", "value", "cls")
    return reshape.to_wide(ev, "slot", "entity", E, ["value", "cls"])


@query("calendar_features", f"""WITH {EV} SELECT ts, event_id, value, CAST(hour(ts) AS DOUBLE) AS hour,
  CAST(isodow(ts) - 1 AS DOUBLE) AS weekday, CAST(month(ts) AS DOUBLE) AS month, CAST(year(ts) AS DOUBLE) AS year
FROM e""")
def q_calendar_features(spark, d):
    ev = S.events_long(spark, d).select("ts", "event_id", "value", "entity")
    return calendar_features(ev, "ts")


# --- sources, catalog, projections --------------------------------------------------------

from wattframe.functions import text as T  # noqa: E402
from wattframe.functions.columns import columns_of_type, normalise_columns  # noqa: E402
from wattframe.functions.hashing import hash_fold  # noqa: E402
from wattframe.operators import evaluate, impute, report  # noqa: E402
from wattframe.operators.features import fit_label_index, fit_minmax, index_to_label  # noqa: E402
from wattframe.operators.sequences import build_sequences, complete_grid  # noqa: E402
from wattframe.schemas import DESCRIPTION_RULES  # noqa: E402
from wattframe.session import scratch_path  # noqa: E402
from wattframe.sources import files as io  # noqa: E402
from pyspark.sql import types as TT  # noqa: E402

_ORDERS_RENAMED = TT.StructType([
    TT.StructField("order_key", TT.LongType()), TT.StructField("cust_key", TT.LongType()),
    TT.StructField("status", TT.StringType()), TT.StructField("total_price", TT.DoubleType()),
    TT.StructField("order_date", TT.TimestampNTZType()), TT.StructField("priority", TT.StringType())])


@query("csv_roundtrip_schema", """SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS status,
  o_totalprice AS total_price, o_orderdate AS order_date, o_orderpriority AS priority FROM orders""")
def q_csv_roundtrip_schema(spark, d):
    path = io.write_csv(io.read_table(spark, d, "orders"), scratch_path(spark, "csv"), mode="errorifexists")
    return io.read_csv(spark, path, _ORDERS_RENAMED, header=True)


_ORDER_LINE = TT.StructType([TT.StructField("order_key", TT.LongType()), TT.StructField("order_date", TT.DateType()),
                             TT.StructField("total_price", TT.DoubleType()), TT.StructField("status", TT.StringType())])


@query("csv_quarantine", """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'total_price' WHEN o_orderkey % 11 = 0 THEN 'number of fields'
  ELSE 'good' END AS reason, count(*) AS n_rows, sum(o_orderkey) AS sum_keys FROM orders GROUP BY 1""")
def q_csv_quarantine(spark, d):
    """Orders as CSV lines, some with text for a price and some without their last field, read with a quarantine."""
    o = io.read_table(spark, d, "orders", ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"])
    price = F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(F.col("o_totalprice").cast("string"))
    status = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus"))
    lines = o.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), price, status).alias("value"))
    path = scratch_path(spark, "lines")
    lines.write.text(path)
    good, bad = io.read_csv_checked(spark, path, _ORDER_LINE)
    rows = good.select(F.lit("good").alias("reason"), F.col("order_key").alias("k")).unionByName(
        bad.select("reason", F.split("line", ",")[0].cast("long").alias("k")))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("k").alias("sum_keys"))


_IMPORTANCE_SCHEMA = TT.StructType([TT.StructField("feature", TT.StringType()),
                                    TT.StructField("weight", TT.LongType())])


@query("json_roundtrip", """SELECT o_orderpriority AS name, count(*) AS split_count FROM orders GROUP BY 1""")
def q_json_roundtrip(spark, d):
    scores = io.read_table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("feature")).agg(
        F.count(F.lit(1)).alias("weight"))
    path = io.write_json(scores, scratch_path(spark, "json"))
    return report.flatten_json(spark, path, _IMPORTANCE_SCHEMA, rename={"feature": "name", "weight": "split_count"},
                               keep=F.col("split_count") > 0)


@query("parquet_overwrite", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'""")
def q_parquet_overwrite(spark, d):
    """A partitioned table replaced as a whole by a second write."""
    orders = io.read_table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    path = io.write_parquet(orders, scratch_path(spark, "overwrite"), partition_by=["o_orderstatus"])
    io.write_parquet(orders.filter("o_orderstatus <> 'F'"), path, mode="overwrite", partition_by=["o_orderstatus"])
    return io.read_parquet(spark, path, orders.columns)


@query("csv_inferred", """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders""")
def q_csv_inferred(spark, d):
    cols = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    path = io.write_csv(io.read_table(spark, d, "orders", cols), scratch_path(spark, "inferred"))
    return io.read_csv(spark, path, None).withColumns({c: F.col(c).cast("long") for c in cols[:2]})


@query("zero_fill", """SELECT c_custkey, coalesce(count(o_orderkey), 0) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def q_zero_fill(spark, d):
    totals = io.read_table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    customers = io.read_table(spark, d, "customer", ["c_custkey"])
    j = customers.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    return impute.fill_zero(j, ["n_orders", "total"])


@query("history_json", """WITH h AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS round, round(avg(o_totalprice), 4) AS mean_price,
  max(o_totalprice) AS max_price FROM orders GROUP BY 1)
SELECT 'orders' AS model, round, 'mean_price' AS metric, mean_price AS value FROM h
UNION ALL SELECT 'orders', round, 'max_price', max_price FROM h""")
def q_history_json(spark, d):
    """A per-round history in long form, handed over as JSON and read back."""
    curve = io.read_table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("round")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.max("o_totalprice").alias("max_price"))
    long = report.history_long(curve, "orders")
    return io.read_json(spark, io.write_json(long, scratch_path(spark, "history")), long.schema)


@query("view_sql", """SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY o_orderstatus""")
def q_view_sql(spark, d):
    return io.run_sql(spark, """SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
        FROM wf_orders GROUP BY o_orderstatus""", wf_orders=io.read_table(spark, d, "orders"))


def _totals_sql() -> str:
    return """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  l_discount + l_tax AS t_rate, l_extendedprice + l_quantity AS t_price,
  l_discount + l_tax + l_extendedprice + l_quantity AS t_all
FROM (""" + S.LINEITEM_GAPS_SQL + ")"


@query("group_totals", _totals_sql())
def q_group_totals(spark, d):
    li = S.lineitem_with_gaps(spark, d)
    return reshape.energy_totals(li, keep=li.columns, totals=S.TOTALS_SPEC)


@query("rename_normalise", """SELECT p_partkey AS p_key, p_name AS p_name_x, p_brand AS p_brand_x, p_type AS p_type_x,
  p_size AS p_size_x, p_retailprice AS p_retail_price_x FROM part""")
def q_rename_normalise(spark, d):
    part = io.read_table(spark, d, "part")
    raw = part.toDF("p key", "p name", "p/brand", "p type", "p size", "p retail-price")
    norm = normalise_columns(raw)
    measures = norm.columns[1:]
    wide = norm.toDF(norm.columns[0], *[f"{m}_x" for m in measures])
    return wide.select(wide.columns[0], *sorted(wide.columns[1:], key=lambda c: wide.columns.index(c)))


@query("project_basics", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  'original' AS dataset, o_orderstatus AS label_pre FROM orders""")
def q_project_basics(spark, d):
    o = io.read_table(spark, d, "orders")
    after_key = o.columns[1:]
    return (o.select(o.columns[0], *after_key).drop("o_orderpriority")
            .withColumn("dataset", F.lit("original")).withColumn("label_pre", F.col("o_orderstatus")))


@query("sort_limit", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def q_sort_limit(spark, d):
    o = io.read_table(spark, d, "orders")
    return o.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


_FLAG_CODE = {"A": 1, "N": 2, "R": 3}


@query("array_map_math", f"""SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 4) AS sqrt_qty,
  round(l_extendedprice, 0) AS price_round, [l_tax, l_discount][1] AS first_rate,
  {_case_map('l_returnflag', _FLAG_CODE)} AS flag_code FROM lineitem""")
def q_array_map_math(spark, d):
    li = io.read_table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(F.sqrt("l_quantity"), 4).alias("sqrt_qty"),
                     F.round("l_extendedprice", 0).alias("price_round"),
                     F.element_at(F.array("l_tax", "l_discount"), 1).alias("first_rate"),
                     resolve.id_map_column(_FLAG_CODE)[F.col("l_returnflag")].alias("flag_code"))


@query("dtype_select", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def q_dtype_select(spark, d):
    li = io.read_table(spark, d, "lineitem")
    return li.select(*columns_of_type(li, "double"))


_BRANDS = ", ".join(f"'{b}'" for b in S.PART_KNOWN_BRANDS)


@query("conditional_icon", f"""SELECT p_partkey, CASE WHEN p_brand IN ({_BRANDS}) THEN p_brand
  ELSE trim(concat(p_brand, 'd')) END AS icon FROM part""")
def q_conditional_icon(spark, d):
    part = io.read_table(spark, d, "part")
    return part.select("p_partkey", T.day_night_icon("p_brand", S.PART_KNOWN_BRANDS).alias("icon"))


def _repair_sql(col: str, rules) -> str:
    expr = col
    for pat, rep in rules:
        expr = f"trim(regexp_replace({expr}, '{pat}', '{rep}', 'g'))"
        expr = f"trim(regexp_replace({expr}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
    return expr


@query("text_repair", f"""SELECT p_partkey, {_repair_sql('p_name', S.PART_NAME_RULES)} AS name_fixed,
  regexp_replace(p_brand, '[\\s\\[\\]]', '', 'g') AS brand_token FROM part""")
def q_text_repair(spark, d):
    part = io.read_table(spark, d, "part")
    return part.select("p_partkey", T.repair_text("p_name", S.PART_NAME_RULES).alias("name_fixed"),
                       T.clean_token("p_brand").alias("brand_token"))


def _repair_sql_plain(col: str, rules) -> str:
    expr = col
    for pat, rep in rules:
        expr = f"trim(regexp_replace({expr}, '{pat}', '{rep}', 'g'))"
    return expr


@query("text_repair_plain_chain", f"""SELECT doc_id, md5(x) AS text_md5 FROM (
  SELECT doc_id, {_repair_sql_plain('text', DESCRIPTION_RULES)} AS x FROM documents)""")
def q_text_repair_plain_chain(spark, d):
    """The description repair chain without blank collapsing (replace, then trim, per rule)."""
    docs = io.read_table(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.md5(T.repair_text("text", DESCRIPTION_RULES, collapse=False)).alias("text_md5"))


@query("document_repair", f"""SELECT doc_id, md5(x) AS text_md5, length(x) AS n_chars_fixed FROM (
  SELECT doc_id, {_repair_sql('text', DESCRIPTION_RULES)} AS x FROM documents)""")
def q_document_repair(spark, d):
    docs = io.read_table(spark, d, "documents", ["doc_id", "text"])
    x = T.repair_text("text", DESCRIPTION_RULES)
    return docs.select("doc_id", F.md5(x).alias("text_md5"), F.length(x).alias("n_chars_fixed"))


@query("predicate_mix", """SELECT event_id FROM events WHERE (event_type = 'click' AND value > 50)
  OR (lower(trim(event_type)) = 'view' AND user_id < 20) OR props IS NULL""")
def q_predicate_mix(spark, d):
    ev = io.read_table(spark, d, "events")
    cond = (((F.col("event_type") == "click") & (F.col("value") > 50))
            | (T.normalised_equals("event_type", "view") & (F.col("user_id") < 20))
            | F.col("props").isNull())
    return ev.filter(cond).select("event_id")


@query("category_profile", "SELECT p_type, p_size, count(*) AS count FROM part GROUP BY 1, 2")
def q_category_profile(spark, d):
    return profile.profile_categories(io.read_table(spark, d, "part"), ["p_type", "p_size"])


def _dictionary_sql() -> str:
    icon = f"CASE WHEN p_brand IN ({_BRANDS}) THEN p_brand ELSE trim(concat(p_brand, 'd')) END"
    return f"""WITH raw AS (SELECT p_size, p_type, p_name, p_brand, count(*) AS n FROM part GROUP BY ALL),
fixed AS (SELECT p_size, p_type, {_repair_sql('p_name', S.PART_NAME_RULES)} AS p_name, {icon} AS p_brand, n FROM raw)
SELECT p_size, p_type, p_name, p_brand, count(*) AS count, CAST(sum(n) AS BIGINT) AS n_rows FROM fixed GROUP BY ALL"""


@query("category_dictionary", _dictionary_sql())
def q_category_dictionary(spark, d):
    return profile.build_dictionary(io.read_table(spark, d, "part"), "p_size", "p_type", "p_name", "p_brand",
                                    rules=S.PART_NAME_RULES, icons=S.PART_KNOWN_BRANDS)


# --- join, concat, totals, nulls ------------------------------------------------------------

@query("inner_two_keys", f"""WITH en AS ({S.LINEITEM_DAILY_SQL}),
we AS (SELECT o_orderdate AS wd, count(*) AS n_orders, sum(o_totalprice) AS tp FROM orders GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d %H:%M:%S') || '+00:00' AS time, round(quantity, 2) AS quantity,
  strftime(wd, '%Y-%m-%d %H:%M:%S') || '+00:00' AS dt_iso, n_orders AS order_count, round(tp, 2) AS total_price,
  CAST(day AS DATE) AS date, day AS date_time
FROM en JOIN we ON en.day = we.wd""")
def q_inner_two_keys(spark, d):
    text = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    energy = S.lineitem_daily(spark, d).select(text("day").alias("time"), F.round("quantity", 2).alias("quantity"))
    orders = io.read_table(spark, d, "orders")
    weather = orders.groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("order count"),
                                                F.round(F.sum("o_totalprice"), 2).alias("total/price"))
    weather = weather.select(text("o_orderdate").alias("dt_iso"), "order count", "total/price")
    j = reshape.join_energy_weather(energy, weather, "time", "dt_iso")
    return j.withColumn("date_time", F.col("date_time").cast("timestamp_ntz"))


@query("column_concat", """SELECT a.event_id, a.value, b.props, coalesce(a.year, b.year) AS year
FROM (SELECT event_id, value, CAST(year(ts) AS DOUBLE) AS year FROM events) a
FULL JOIN (SELECT event_id, props, CAST(year(ts) AS DOUBLE) AS year FROM events WHERE year(ts) = 2024) b
ON a.event_id = b.event_id""")
def q_column_concat(spark, d):
    from wattframe.functions.time import year_range
    ev = io.read_table(spark, d, "events")
    a = ev.select("event_id", "value", F.year("ts").cast("double").alias("year"))
    b = ev.filter(year_range("ts", 2024)).select("event_id", "props", F.year("ts").cast("double").alias("year"))
    j = a.join(b.withColumnRenamed("year", "year_b"), "event_id", "full")
    return j.select("event_id", "value", "props", F.coalesce("year", "year_b").alias("year"))


_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("means_and_std", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS series, avg({c}) AS mean, stddev_samp({c}) AS std, count({c}) AS n FROM lineitem"
    for c in _NUMS))
def q_means_and_std(spark, d):
    return evaluate.mean_std_wide(io.read_table(spark, d, "lineitem", _NUMS), _NUMS)


_PAIRS = {("gross", "price"): ("l_extendedprice", "p_gross"), ("net", "price"): ("l_extendedprice", "p_net"),
          ("unit", "quantity"): ("l_quantity", "p_unit"), ("sparse", "quantity"): ("l_quantity", "p_sparse")}
_PRED_COLS = {"p_gross": "l_extendedprice * (1 + l_tax)", "p_net": "l_extendedprice * (1 - l_discount)",
              "p_unit": "l_extendedprice / 1000", "p_sparse": "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity + 1 END"}


def _rmse_sql() -> str:
    preds = ", ".join(f"{v} AS {k}" for k, v in _PRED_COLS.items())
    parts = []
    for (m, t), (a, p) in _PAIRS.items():
        parts.append(f"""SELECT '{m}' AS model, '{t}' AS target,
  round(sqrt(avg(CASE WHEN {a} IS NOT NULL AND {p} IS NOT NULL THEN ({a} - {p}) ^ 2 END)), 4) AS rmse,
  count(*) FILTER (WHERE {a} IS NOT NULL AND {p} IS NOT NULL) AS n_pairs,
  count(*) FILTER (WHERE NOT ({a} IS NOT NULL AND {p} IS NOT NULL)) AS n_null_pairs FROM p""")
    return f"WITH p AS (SELECT *, {preds} FROM lineitem)\n" + "\nUNION ALL\n".join(parts)


@query("rmse_matrix", _rmse_sql())
def q_rmse_matrix(spark, d):
    li = io.read_table(spark, d, "lineitem")
    li = li.withColumns({k: F.expr(v) for k, v in _PRED_COLS.items()})
    return evaluate.rmse_wide(li, _PAIRS)


@query("rmse_matrix_long", _rmse_sql())
def q_rmse_matrix_long(spark, d):
    """RMSE through the long path: stacked (model, target, actual, predicted) rows, then grouped."""
    li = io.read_table(spark, d, "lineitem")
    li = li.withColumns({k: F.expr(v) for k, v in _PRED_COLS.items()})
    return evaluate.rmse_matrix(evaluate.stack_predictions(li, ["l_orderkey", "l_linenumber"], _PAIRS))


@query("means_and_std_long", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS series, avg({c}) AS mean, stddev_samp({c}) AS std, count({c}) AS n FROM lineitem"
    for c in _NUMS))
def q_means_and_std_long(spark, d):
    """Mean and std through the long path: unpivot, then grouped."""
    li = io.read_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", *_NUMS])
    return evaluate.mean_std_matrix(reshape.to_long(li, ["l_orderkey", "l_linenumber"], _NUMS))


@query("impute_means", f"""WITH g AS ({S.LINEITEM_GAPS_SQL})
SELECT l_orderkey, l_linenumber, coalesce(l_quantity, avg(l_quantity) OVER ()) AS l_quantity,
  coalesce(l_discount, avg(l_discount) OVER ()) AS l_discount, l_tax FROM g""")
def q_impute_means(spark, d):
    g = S.lineitem_with_gaps(spark, d)
    out = impute.impute_means(g)
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")


@query("drop_nulls", f"""SELECT l_orderkey, l_linenumber FROM ({S.LINEITEM_GAPS_SQL})
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL""")
def q_drop_nulls(spark, d):
    return impute.drop_incomplete(S.lineitem_with_gaps(spark, d)).select("l_orderkey", "l_linenumber")


@query("null_summary", f"""SELECT count(*) FILTER (WHERE l_quantity IS NULL OR l_discount IS NULL) AS rows_with_null,
  count(*) FILTER (WHERE l_quantity IS NULL) AS null_quantity, count(*) FILTER (WHERE l_discount IS NULL) AS null_discount
FROM ({S.LINEITEM_GAPS_SQL})""")
def q_null_summary(spark, d):
    n = profile.null_counts(S.lineitem_with_gaps(spark, d))
    return n.select(F.col("__rows_with_null").alias("rows_with_null"), F.col("l_quantity").alias("null_quantity"),
                    F.col("l_discount").alias("null_discount"))


# --- time parsing, splits, folds ------------------------------------------------------------

@query("parse_times", """SELECT o_orderkey, o_orderdate - INTERVAL 1 HOUR AS utc_time,
  CAST(epoch(o_orderdate - INTERVAL 1 HOUR) AS BIGINT) AS epoch,
  strftime(o_orderdate - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS utc_text,
  CAST(o_orderdate - INTERVAL 1 HOUR AS DATE) AS utc_date, printf('%.2f%%', o_totalprice / 7) AS price_pct
FROM orders""")
def q_parse_times(spark, d):
    from wattframe.functions.time import OFFSET_PATTERN, parse_offset_timestamp
    o = io.read_table(spark, d, "orders")
    s = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("+01:00"))
    epoch = F.unix_timestamp(s, OFFSET_PATTERN)
    return o.select("o_orderkey", parse_offset_timestamp(s).alias("utc_time"), epoch.alias("epoch"),
                    F.from_unixtime(epoch, "yyyy-MM-dd HH:mm:ss").alias("utc_text"),
                    F.to_date(parse_offset_timestamp(s)).alias("utc_date"),
                    F.format_string("%.2f%%", F.col("o_totalprice") / 7).alias("price_pct"))


@query("year_split", """SELECT l_orderkey, l_linenumber, CASE WHEN year(l_shipdate) = 2000 THEN 'test' ELSE 'train' END AS split
FROM lineitem""")
def q_year_split(spark, d):
    li = io.read_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate"])
    train, test = sampling.year_split(li, "l_shipdate", 2000)
    cols = ["l_orderkey", "l_linenumber"]
    return train.select(*cols, F.lit("train").alias("split")).unionByName(test.select(*cols, F.lit("test").alias("split")))


@query("time_boundaries", f"""SELECT hour, CASE WHEN hour < TIMESTAMP '2024-01-15' THEN 'train'
  WHEN hour < TIMESTAMP '2024-01-25' THEN 'validation' ELSE 'test' END AS split FROM ({S.HOURLY_EVENTS_SQL})""")
def q_time_boundaries(spark, d):
    h = S.hourly_events(spark, d)
    return h.select("hour", sampling.time_split_label("hour", ["2024-01-15", "2024-01-25"]).alias("split"))


@query("fold_assignment", """WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)
SELECT event_id,
  CAST(('0x' || substr(md5(concat_ws(':', '123', coalesce(CAST(event_id AS VARCHAR), ''))), 1, 8))::BIGINT % 3 AS INTEGER) AS fold_shuffled,
  CAST(least(floor((epoch_us(ts) - lo) * 2 / (hi - lo + 1)), 1) AS INTEGER) AS fold_contiguous
FROM events, b""")
def q_fold_assignment(spark, d):
    ev = io.read_table(spark, d, "events", ["event_id", "ts"])
    return ev.select("event_id", hash_fold(["event_id"], 3, 123).alias("fold_shuffled"),
                     sampling.contiguous_folds(ev, "ts", 2).alias("fold_contiguous"))


_RANKED = "(SELECT *, row_number() OVER (ORDER BY ts NULLS FIRST, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)"


@query("positional_split", f"""SELECT event_id, CASE WHEN pos < 600 THEN 'train' WHEN pos < 800 THEN 'validation' ELSE 'test' END AS split
FROM {_RANKED} WHERE pos < 600 OR pos >= 624""")
def q_positional_split(spark, d):
    """Row ranges in time order, with a gap of a day's rows between training and validation."""
    ev = io.read_table(spark, d, "events", ["event_id", "ts"])
    cuts = {"train": (None, 600), "validation": (624, 800), "test": (800, None)}
    return positions.positional_split(ev, ["ts", "event_id"], cuts).select("event_id", "split")


@query("positional_folds", f"""SELECT event_id, pos AS position,
  CAST(CASE WHEN pos < n % 7 * (n // 7 + 1) THEN pos // (n // 7 + 1) ELSE n % 7 + (pos - n % 7 * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold
FROM {_RANKED}""")
def q_positional_folds(spark, d):
    ev = io.read_table(spark, d, "events", ["event_id", "ts"])
    at = positions.with_positions(ev, ["ts", "event_id"]).select("event_id", "position")
    return at.join(positions.positional_folds(ev, ["ts", "event_id"], 7), "event_id").select("event_id", "position", "fold")


@query("positional_concat", f"""SELECT event_id, o_orderkey FROM {_RANKED} a FULL JOIN
(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate NULLS FIRST, o_orderkey) - 1 AS pos FROM orders) b ON a.pos = b.pos""")
def q_positional_concat(spark, d):
    ev = io.read_table(spark, d, "events", ["event_id", "ts"])
    orders = io.read_table(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    return positions.concat_columns(ev, orders, ["ts", "event_id"], ["o_orderdate", "o_orderkey"], "full").select("event_id", "o_orderkey")


# --- sequences, scaling, label index --------------------------------------------------------

def _sequence_sql() -> str:
    return f"""WITH h AS ({S.HOURLY_EVENTS_SQL}),
b AS (SELECT min(hour) AS t0, CAST((epoch(max(hour)) - epoch(min(hour))) / 3600 AS BIGINT) + 1 AS n FROM h),
g AS (SELECT r.range AS idx, b.t0 + to_hours(r.range) AS hour FROM b, range(0, (SELECT n FROM b)) r),
i AS (SELECT g.idx, g.hour, coalesce(h.x, 0) AS x, coalesce(h.y, 0) AS y,
        CASE WHEN g.hour < TIMESTAMP '2024-01-16' THEN 'a' ELSE 'b' END AS split FROM g LEFT JOIN h ON g.hour = h.hour),
w AS (SELECT split, idx, y, count(*) OVER win AS n, first_value(x) OVER win AS first_x, last_value(x) OVER win AS last_x,
        sum(x) OVER win AS sum_x FROM i
      WINDOW win AS (PARTITION BY split ORDER BY idx RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT split, idx, round(y, 4) AS label, CAST(n AS INTEGER) AS n_steps, first_x, last_x, sum_x FROM w WHERE n = 24"""


@query("sequence_history", _sequence_sql())
def q_sequence_history(spark, d):
    return _sequence_history(spark, d, "blocks")


@query("sequence_history_explode", _sequence_sql())
def q_sequence_history_explode(spark, d):
    """The same sequences built by the explode-to-targets method."""
    return _sequence_history(spark, d, "explode")


def _sequence_history(spark, d, method):
    h = S.hourly_events(spark, d)
    b = h.agg(F.min("hour").alias("t0"), F.max("hour").alias("t1")).first()
    n = int((b["t1"] - b["t0"]).total_seconds() // 3600) + 1
    grid = complete_grid(spark, b["t0"], n, ts_col="hour")
    full = grid.join(h, "hour", "left").na.fill(0.0, ["x", "y"])
    full = full.withColumn("split", F.when(F.col("hour") < F.lit("2024-01-16").cast("timestamp_ntz"), "a").otherwise("b"))
    seq = build_sequences(full, "idx", "x", "y", history=24, split_col="split", method=method)
    return seq.select("split", "idx", F.round("label", 4).alias("label"), F.size("history").alias("n_steps"),
                      F.element_at("history", 1).alias("first_x"), F.element_at("history", -1).alias("last_x"),
                      F.aggregate("history", F.lit(0.0), lambda a, x: a + x).alias("sum_x"))


_TRAIN_END = "2024-01-21"


def _minmax_sql(body: str) -> str:
    return f"""WITH h AS ({S.HOURLY_EVENTS_SQL}),
m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM h WHERE hour < TIMESTAMP '{_TRAIN_END}')
{body}"""


@query("minmax_scale", _minmax_sql("""SELECT hour, (x - x0) / (x1 - x0) AS x_scaled,
  (y - y0) / (y1 - y0) AS y_scaled FROM h, m"""))
def q_minmax_scale(spark, d):
    h = S.hourly_events(spark, d)
    model = fit_minmax(h.filter(F.col("hour") < F.lit(_TRAIN_END).cast("timestamp_ntz")), ["x", "y"])
    out = model.transform(h, suffix="_scaled")
    return out.select("hour", "x_scaled", "y_scaled")


@query("minmax_inverse", _minmax_sql("""SELECT hour, round(y, 4) AS y_back,
  round(abs(y - 0.5 * (y1 - y0) - y0) / (y1 - y0) * (y1 - y0), 4) AS err_back FROM h, m"""))
def q_minmax_inverse(spark, d):
    h = S.hourly_events(spark, d)
    model = fit_minmax(h.filter(F.col("hour") < F.lit(_TRAIN_END).cast("timestamp_ntz")), ["x", "y"])
    scaled = model.transform(h, suffix="_scaled")
    return scaled.select("hour", F.round(model.inverse_column("y_scaled", "y"), 4).alias("y_back"),
                         F.round(model.inverse_error(F.abs(F.col("y_scaled") - 0.5), "y"), 4).alias("err_back"))


@query("label_index", f"""WITH {EV}, o AS (SELECT cls, CAST(row_number() OVER (ORDER BY count(*) DESC, cls) - 1 AS DOUBLE) AS label_idx
  FROM e GROUP BY cls)
SELECT e.event_id, e.cls, o.label_idx, o.cls AS cls_back FROM e JOIN o ON e.cls = o.cls""")
def q_label_index(spark, d):
    ev = S.events_long(spark, d).select("event_id", "cls")
    model = fit_label_index(ev, "cls", "label_idx")
    out = model.transform(ev)
    return index_to_label(model, "label_idx", "cls_back").transform(out)


@query("prediction_distribution", f"WITH {EV} SELECT pred_cls, count(*) AS count FROM e GROUP BY pred_cls")
def q_prediction_distribution(spark, d):
    return profile.profile_categories(S.events_long(spark, d), ["pred_cls"])


# --- metrics and report tables --------------------------------------------------------------

def _metrics_sql() -> str:
    return f"""WITH {EV}, cm AS (SELECT cls AS label, pred_cls AS prediction, count(*) AS n FROM e GROUP BY 1, 2),
tp AS (SELECT label AS c, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp, sum(n) AS n_label FROM cm GROUP BY 1),
pp AS (SELECT prediction AS c, sum(n) AS n_pred FROM cm GROUP BY 1),
per AS (SELECT coalesce(tp.c, pp.c) AS c, coalesce(tp, 0) AS tp, coalesce(n_label, 0) AS n_label,
               coalesce(n_pred, 0) AS n_pred FROM tp FULL JOIN pp ON tp.c = pp.c),
m AS (SELECT c, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS p,
             CASE WHEN n_label > 0 THEN tp / n_label ELSE 0.0 END AS r FROM per),
tot AS (SELECT sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS hits, sum(n) AS rows FROM cm),
acc AS (SELECT hits / rows AS a, 2 * (rows - hits) / (rows * (SELECT count(*) FROM per WHERE n_label > 0)) AS h FROM tot)
SELECT c AS label, 'precision' AS metric, p AS value FROM m
UNION ALL SELECT c, 'recall', r FROM m
UNION ALL SELECT c, 'f1', CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END FROM m
UNION ALL SELECT 'ALL', unnest(['accuracy', 'precision', 'recall', 'f1', 'micro_precision', 'micro_recall', 'micro_f1',
  'subset_accuracy', 'hamming_loss']), unnest([a, a, a, a, a, a, a, a, h]) FROM acc"""


@query("confusion_and_labels", _metrics_sql())
def q_confusion_and_labels(spark, d):
    return evaluate.classification_metrics(S.events_long(spark, d), "cls", "pred_cls")


@query("error_direction", f"""WITH {EV} SELECT CASE WHEN p - l > 0 THEN 'pos_diff' WHEN p - l < 0 THEN 'neg_diff' ELSE 'same' END
  AS pred_label_diff, cls, count(*) AS count FROM (SELECT cls, {_case_map('cls', S.BAND_MIN_ID)} AS l,
  {_case_map('pred_cls', S.BAND_MIN_ID)} AS p FROM e) GROUP BY 1, 2""")
def q_error_direction(spark, d):
    m = resolve.id_map_column(S.BAND_MIN_ID)
    ev = S.events_long(spark, d).select("cls", m[F.col("cls")].alias("l"), m[F.col("pred_cls")].alias("p"))
    return evaluate.error_direction(ev, "l", "p", "cls")


@query("topk_features", """SELECT * FROM (SELECT l_returnflag, l_suppkey AS feature, count(*) AS score,
  CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_suppkey) AS INTEGER) AS rank
  FROM lineitem GROUP BY 1, 2) WHERE rank <= 10""")
def q_topk_features(spark, d):
    li = io.read_table(spark, d, "lineitem", ["l_returnflag", "l_suppkey"])
    scores = li.groupBy("l_returnflag", F.col("l_suppkey").alias("feature")).agg(F.count(F.lit(1)).alias("score"))
    return report.top_k_per_group(scores, ["l_returnflag"], "score", 10, tie=["feature"])


@query("trailing_period", """WITH t AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY)
SELECT event_id, ts, 'value' AS series, value FROM t
UNION ALL SELECT event_id, ts, 'user_id', CAST(user_id AS DOUBLE) FROM t""")
def q_trailing_period(spark, d):
    ev = io.read_table(spark, d, "events", ["event_id", "ts", "value", "user_id"])
    t = report.trailing_period(ev, "ts", report.TRAILING_PERIODS["1w"]).withColumn("user_id", F.col("user_id").cast("double"))
    return reshape.to_long(t, ["event_id", "ts"], ["value", "user_id"])


@query("trailing_windows", """WITH m AS (SELECT max(ts) AS t1 FROM events)
SELECT p.period, count(*) AS n_rows, sum(e.value) AS total_value
FROM events e, m, (VALUES ('1w', INTERVAL 7 DAY), ('1m', INTERVAL 1 MONTH), ('3m', INTERVAL 3 MONTH),
                          ('6m', INTERVAL 6 MONTH), ('1y', INTERVAL 1 YEAR)) p(period, iv)
WHERE e.ts > m.t1 - p.iv GROUP BY p.period""")
def q_trailing_windows(spark, d):
    ev = io.read_table(spark, d, "events", ["ts", "value"])
    tagged = report.trailing_periods(ev, "ts", report.TRAILING_PERIODS)
    return tagged.groupBy("period").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total_value"))


@query("entity_daily_metric", """SELECT event_type AS entity, CAST(ts AS DATE) AS date, avg(value) AS avg_value
FROM events GROUP BY 1, 2""")
def q_entity_daily_metric(spark, d):
    ev = S.events_long(spark, d)
    return report.entity_daily_metric(ev, "ts", "entity", "value")


# --- energy ⋈ weather table (end to end, oracle-checked) ------------------------------------

from wattframe.plans import energy as EN  # noqa: E402
from wattframe.plans import forecast as FC  # noqa: E402
from wattframe.plans import weather as WE  # noqa: E402
from wattframe.schemas import normalise_name  # noqa: E402


def _energy_weather_sql() -> str:
    P, M = S.PRIORITIES, S.ORDER_MEASURES
    wcols = [(m, p, normalise_name(f"{m}_{p}")) for p in P for m in M]
    ww = ", ".join(f"min(CASE WHEN o_orderpriority = '{p}' THEN {m} END) AS \"{n}\"" for m, p, n in wcols)
    base = ["quantity", "price", "discount", "tax", "lines", "returns", "t_value", "t_rates", "t_all"]
    imp = lambda c: f"coalesce(\"{c}\", avg(\"{c}\") OVER ()) AS \"{c}\""
    wsel = ", ".join(imp(n) if m == "o_totalprice" else f"\"{n}\"" for m, p, n in wcols)
    return f"""WITH d AS ({S.LINEITEM_DAILY_SQL}),
en AS (SELECT strftime(day, '%Y-%m-%d %H:%M:%S') || '+00:00' AS time, quantity, price, discount, tax, lines, returns,
  price + quantity AS t_value, discount + tax AS t_rates, price + quantity + discount + tax AS t_all FROM d),
ww AS (SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+00:00' AS dt_iso, {ww} FROM orders GROUP BY o_orderdate),
j AS (SELECT * FROM en JOIN ww ON en.time = ww.dt_iso)
SELECT time, {', '.join(imp(c) for c in base)}, dt_iso, {wsel},
  CAST(substr(time, 1, 10) AS DATE) AS date, CAST(substr(time, 1, 19) AS TIMESTAMP) AS date_time FROM j"""


def _energy_weather(spark, d, impute=True):
    wide = reshape.to_wide(S.orders_long(spark, d), "dt_iso", "priority", S.PRIORITIES, S.ORDER_MEASURES)
    return EN.energy_weather_table(S.daily_energy(spark, d), wide, keep=S.DAILY_KEEP, totals=S.DAILY_TOTALS,
                                   impute=impute)


@query("energy_weather_table", _energy_weather_sql())
def q_energy_weather_table(spark, d):
    t = _energy_weather(spark, d)
    return t.withColumn("date_time", F.col("date_time").cast("timestamp_ntz"))


def _quality_before_after_sql() -> str:
    P, M = S.PRIORITIES, S.ORDER_MEASURES
    ww = ", ".join(f"min(CASE WHEN o_orderpriority = '{p}' THEN {m} END) AS {m}_{i}" for i, p in enumerate(P) for m in M)
    anynull = " OR ".join(f"{m}_{i} IS NULL" for i in range(len(P)) for m in M)
    strnull = " OR ".join(f"o_orderstatus_{i} IS NULL" for i in range(len(P)))
    return f"""WITH ww AS (SELECT o_orderdate AS day, {ww} FROM orders GROUP BY o_orderdate),
d AS (SELECT DISTINCT l_shipdate AS day FROM lineitem), j AS (SELECT ww.* FROM ww JOIN d ON ww.day = d.day)
SELECT count(*) FILTER (WHERE {anynull}) AS rows_with_null_before,
  count(*) FILTER (WHERE {strnull}) AS rows_with_null_after FROM j"""


@query("energy_weather_quality", _quality_before_after_sql())
def q_energy_weather_quality(spark, d):
    before = _energy_weather(spark, d, impute=False)
    return EN.null_report(before, _energy_weather(spark, d))


# --- classifiers and resolution (rows-only: model outputs) ----------------------------------

_CLS_INPUTS = ["user_id_d", "k_d", "minute_d", "second_d"]


def _weather_like(spark, d):
    ev = S.events_long(spark, d)
    return ev.select("event_id", "slot", "entity", "cls", "cls_id", "value",
                     F.col("user_id").cast("double").alias("user_id_d"),
                     F.get_json_object("props", "$.k").cast("double").alias("k_d"),
                     F.minute("ts").cast("double").alias("minute_d"), F.second("ts").cast("double").alias("second_d"))


@query("classify_entity")
def q_classify_entity(spark, d):
    ev = _weather_like(spark, d)
    dup_keys = profile.duplicate_matrix(ev, "slot", "entity", E).select("slot")
    from functools import reduce
    _, metrics, _ = WE.train_and_evaluate_classifier(ev, "slot", "entity", "click", _CLS_INPUTS, "cls", dup_keys,
                                                     classifier=["rf", "dt", "lr", "mlp"], id_cols=["event_id"])
    return reduce(lambda a, b: a.unionByName(b), [m.withColumn("classifier", F.lit(n)) for n, m in metrics.items()])


@query("predict_duplicates")
def q_predict_duplicates(spark, d):
    ev = _weather_like(spark, d)
    dup_keys = profile.duplicate_matrix(ev, "slot", "entity", E).select("slot")
    p = WE.predict_duplicates(ev, "slot", "entity", "view", _CLS_INPUTS, "cls", dup_keys, id_cols=["event_id"])
    return p.select("event_id", "slot", "entity", "cls", "prediction", "predictedLabel")


@query("resolve_weather")
def q_resolve_weather(spark, d):
    ev = _weather_like(spark, d)
    _, merged = WE.resolve_duplicates(ev, "slot", "entity", E, _CLS_INPUTS, "cls", "cls_id", S.BAND_MIN_ID, "event_id")
    return WE.wide_weather(merged.select("slot", "entity", "value", "cls"), "slot", "entity", E)


@query("energy_weather_flow")
def q_energy_weather_flow(spark, d):
    """The whole preparation flow (CSV in → resolved, wide, joined, imputed table) on files derived
    from ``events`` in the source schemas."""
    from wattframe.plans.flow import build_tables
    energy, weather = S.flow_inputs(spark, d)
    e_path = io.write_csv(energy, scratch_path(spark, "flow", "energy"))
    w_path = io.write_csv(weather, scratch_path(spark, "flow", "weather"))
    return build_tables(spark, e_path, w_path, expected_hours=None)["energy_weather"]


# --- forecasting (rows-only: model outputs) -------------------------------------------------

_ROUNDS = 50  # the library's defaults are 500; see README for the cost of a round
_DAILY_TREES = {"learning_rate": 0.07, "max_depth": 5, "n_estimators": _ROUNDS}
_DAILY_TARGETS = ("price", "quantity", "discount", "tax")
# the depths of the four targets that these play, and the L1 penalty of leaf values
_DAILY_BEST = {t: {**_DAILY_TREES, "max_depth": depth, "alpha": 10.0} for t, depth in zip(_DAILY_TARGETS, (7, 7, 6, 5))}
_DAILY_SPLITS = ["1999-01-01", "2000-01-01"]


@query("forecast_trees")
def q_forecast_trees(spark, d):
    df = S.daily_features(spark, d)
    aside = df.select("day", F.col("returns").alias("returns_aside"))
    return FC.forecast_targets(df.drop("returns"), "day", {t: f"{t}_predicted" for t in _DAILY_TARGETS}, 2000,
                               _DAILY_BEST, set_aside=aside)


@query("forecast_trees_frame", f"""WITH d AS ({S.LINEITEM_DAILY_SQL})
SELECT a.day, a.price, a.quantity, a.discount, a.tax, b.price AS price_published, a.returns AS returns_aside
FROM d a LEFT JOIN d b ON a.day = b.day + INTERVAL 7 DAY WHERE year(a.day) = 2000""")
def q_forecast_trees_frame(spark, d):
    """The frame of the tree forecast: every test-year day with a forecast of all four targets, its actuals, the
    set-aside block and, where there is one, the value of a week before."""
    df = S.daily_features(spark, d)
    aside = df.select("day", F.col("returns").alias("returns_aside"))
    out = FC.forecast_targets(df.drop("returns"), "day", {t: f"{t}_predicted" for t in _DAILY_TARGETS}, 2000, _DAILY_BEST, set_aside=aside)
    out = out.filter(" and ".join(f"{t}_predicted is not null" for t in _DAILY_TARGETS))
    out = out.join(_week_before(df).select("day", "price_published"), "day", "left")
    return out.select("day", *_DAILY_TARGETS, "price_published", "returns_aside")


@query("cv_curve")
def q_cv_curve(spark, d):
    return FC.cv_curve(S.daily_features(spark, d), "day", "price", _DAILY_TREES, k=3, rounds=50, early_stop=10)


@query("split_importance")
def q_split_importance(spark, d):
    return FC.split_importance(S.daily_features(spark, d), "day", "price", _DAILY_TREES, rounds=10)


@query("tune_trees")
def q_tune_trees(spark, d):
    """The grid's scores, the chosen point and its test RMSE."""
    from wattframe.schemas import TREE_GRID
    return FC.tuning_report(*FC.tune_trees(S.daily_features(spark, d), "day", "price", TREE_GRID, folds=2, n_estimators=20,
                                           test_year=2000))


@query("forecast_from_history")
def q_forecast_from_history(spark, d):
    """All four targets of the test year from the history model, next to the actuals."""
    return FC.forecast_history_targets(S.daily_features(spark, d), "day", {t: f"{t}_history" for t in _DAILY_TARGETS},
                                       boundaries=_DAILY_SPLITS, history=24, unit_seconds=86400)


@query("history_curve")
def q_history_curve(spark, d):
    df = S.daily_features(spark, d)
    _, _, history = FC.forecast_from_history(df, "day", "price", _DAILY_SPLITS, history=24,
                                             unit_seconds=86400, model="gbt", max_iter=50)
    return history


def _week_before(df):
    return df.select(F.date_add(F.col("day").cast("date"), 7).cast("timestamp_ntz").alias("day"),
                     *[F.col(t).alias(f"{t}_published") for t in _DAILY_TARGETS])


@query("compare_models")
def q_compare_models(spark, d):
    """Four targets by three models (the value of a week before plays the published forecast), mean and std."""
    df = S.daily_features(spark, d)
    trees = FC.forecast_targets(df, "day", {t: f"{t}_trees" for t in _DAILY_TARGETS}, 2000, _DAILY_BEST)
    past = FC.forecast_history_targets(df, "day", {t: f"{t}_history" for t in _DAILY_TARGETS}, boundaries=_DAILY_SPLITS,
                                       history=24, unit_seconds=86400).drop(*_DAILY_TARGETS)
    wide = trees.join(past, "day", "left").join(_week_before(df), "day", "left")
    return FC.comparison_report(wide, {(m, t): (t, f"{t}_{m}") for t in _DAILY_TARGETS for m in ("published", "trees", "history")})


def _compare_published_sql() -> str:
    err = " UNION ALL ".join(f"SELECT '{t}' AS target, a.{t} AS x, b.{t} AS p FROM a LEFT JOIN d b ON b.day = a.day - INTERVAL 7 DAY"
                             for t in _DAILY_TARGETS)
    return f"""WITH d AS ({S.LINEITEM_DAILY_SQL}), a AS (SELECT * FROM d WHERE year(day) = 2000), e AS ({err})
SELECT 'published' AS model, target, round(sqrt(avg((x - p) * (x - p))), 2) AS rmse, count(p) AS n_pairs,
  count(*) - count(p) AS n_null_pairs FROM e GROUP BY target"""


@query("compare_published", _compare_published_sql())
def q_compare_published(spark, d):
    """The published model's row of the comparison, which no fit goes into."""
    from wattframe.operators.sampling import year_split
    df = S.daily_features(spark, d)
    wide = year_split(df, "day", 2000)[1].join(_week_before(df), "day", "left")
    rm, _ = FC.compare_models(wide, "day", {("published", t): (t, f"{t}_published") for t in _DAILY_TARGETS})
    return rm.withColumn("rmse", F.round("rmse", 2))


@query("pca_variance")
def q_pca_variance(spark, d):
    from pyspark.ml.functions import array_to_vector
    from wattframe.operators.features import fit_centred_pca
    emb = io.read_table(spark, d, "embeddings").select("vec_id", array_to_vector(
        F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = fit_centred_pca(emb, "features", "pca", 0.80)
    from pyspark.ml.functions import vector_to_array
    return model.transform(emb).select("vec_id", F.lit(model.k).alias("k"), vector_to_array("pca").alias("pca"))


_EXPECT = {"hours": 720, "hour_entities": 3600, "complete_wide_rows": 720}


@query("expected_counts", f"""WITH {EV},
c AS (SELECT 'hours' AS "check", 720 AS expected, (SELECT count(DISTINCT hour) FROM e) AS actual
  UNION ALL SELECT 'hour_entities', 3600, (SELECT count(*) FROM (SELECT DISTINCT hour, entity FROM e))
  UNION ALL SELECT 'complete_wide_rows', 720, (SELECT count(*) FROM (SELECT hour FROM e GROUP BY hour
    HAVING count(DISTINCT entity) = {len(E)})))
SELECT "check", CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, expected = actual AS ok FROM c""")
def q_expected_counts(spark, d):
    ev = S.events_long(spark, d)
    wide = reshape.to_wide(ev.select("hour", "entity", "value"), "hour", "entity", E, ["value"], agg="min")
    complete = impute.drop_incomplete(wide)
    return report.expectation_table({"hours": ev.select("hour").distinct(),
                                     "hour_entities": ev.select("hour", "entity").distinct(),
                                     "complete_wide_rows": complete}, _EXPECT)


# --- training-data operators (optional subpackage) ------------------------------------------

def _present(module: str) -> bool:
    try:
        return importlib.util.find_spec(module) is not None
    except ModuleNotFoundError:  # the parent package is not there
        return False


if _present("wattframe.llm.queries"):
    from wattframe.llm import queries as _llm

    _QUERIES.update(_llm.QUERIES)
    _SQL.update(_llm.ORACLE_SQL)
    if _present("corpus_pipeline"):
        import corpus_pipeline

        _QUERIES["pipeline"] = corpus_pipeline.query
        if corpus_pipeline.ORACLE_SQL is not None:
            _SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


# --- contract -------------------------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: hour × entity duplicate matrix over the smoke tables."""
    return _QUERIES["duplicate_matrix"](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
