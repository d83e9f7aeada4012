"""Resolving repeated (key, entity) rows: the three-case selector and the merge back.

``select_predicted`` flags, per (key, entity), the row(s) to keep given a predicted class per row:

1. the row's class equals its predicted class and it is the only row of the first peer group
   (rule ``"running"``: rows of (key, entity, class) ordered by id difference, nulls first, the
   count includes peers) — or the only row of its class (rule ``"group_size"``);
2. otherwise the first row of its class by id difference when that difference is 0;
3. if no row of the (key, entity) was picked by 1 or 2: the first row of its class that carries the
   smallest id of the (key, entity).

``id difference`` = row id − smallest id of the predicted class (``id_map``; NULL if the class is not
in the map).  Ties in the ordering are broken by ``row_id``.

Plan shape: one form for all groups.  Equal rows collapse into one with a count (partial aggregation),
the rule is evaluated on shrinking hash aggregates (per row id, peer group, class and (key, entity)) and
joined back once by an equi-join that AQE can broadcast or skew-split; the copies are dealt out again
at the end, and only the first copy of a row can be kept.  A hot group, say a third of all rows, is
never in one task.  The flags equal those of the four window functions the rule is written with
(property-tested against a row-by-row evaluation, with repeated row ids and exact copies).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.operators.joins import keyed_join, semi_join


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def id_map_column(id_map: dict[str, int]):
    """Map literal ``class -> id`` as a Column (looked up with ``[col]``; a miss gives NULL)."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in id_map.items()))


def select_predicted(df: DataFrame, key, class_col: str, id_col: str, pred_col: str,
                     id_map: dict[str, int], row_id: str, entity: str | None = None,
                     rule: str = "running", flag_col: str = "select_flag",
                     keep_helpers: bool = False) -> DataFrame:
    """Add ``flag_col`` (0/1/2…: 1 = keep) to every row; see the module docstring for the rule.

    ``row_id`` need not be unique: rows that share it are ordered by a hash of the whole row, and of
    exact copies the first counts as one row, the others as further peers.
    """
    if rule not in ("running", "group_size"):
        raise ValueError("rule must be 'running' or 'group_size'")
    grp = _keys(key) + ([entity] if entity else [])
    cls = grp + [class_col]
    rows = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    d = _with_diff(rows, id_col, pred_col, id_map).withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))

    # Ordering key of the (key, entity, class) window: diff ascending, nulls first.  A null diff
    # becomes -inf so every reduction below is a fixed-width min / min_by (hash aggregation with a
    # map-side partial step) rather than a sort-based aggregation over structs.
    okey = F.when(F.col("pred_min_id_diff").isNull(), F.lit(float("-inf"))).otherwise(F.col("pred_min_id_diff"))
    match = F.coalesce(F.col(pred_col) == F.col(class_col), F.lit(False)).cast("int")
    # level 0: rows that share an id — their first by hash
    ids = (d.withColumn("_ok", okey).withColumn("_m", match)
           .groupBy(*cls, "_ok", F.col(row_id).alias("_rid"))
           .agg(F.sum("_copies").alias("_n"), F.min("_h").alias("_h1"), F.min_by("_m", "_h").alias("_m"), F.min(id_col).alias("_minid")))
    # level 1: peer groups (key, entity, class, diff) — size, first row, whether that row's
    # prediction equals its class, smallest id
    peers = ids.groupBy(*cls, "_ok").agg(
        F.sum("_n").alias("_n"), F.min("_rid").alias("_r1"), F.min_by("_h1", "_rid").alias("_h1"),
        F.min_by("_m", "_rid").alias("_m"), F.min("_minid").alias("_minid"))
    # level 2: per class — the first peer group, its first row, class size
    per_cls = peers.groupBy(*cls).agg(
        F.min_by("_n", "_ok").alias("_n1"), F.min_by("_r1", "_ok").alias("_r1"), F.min_by("_h1", "_ok").alias("_h1"),
        F.min_by("_m", "_ok").alias("_m1"), F.min("_ok").alias("_ok1"),
        F.sum("_n").alias("_size"), F.min("_minid").alias("_minid"))
    first_n = F.col("_n1") if rule == "running" else F.col("_size")
    sc1 = (F.col("_m1") == 1) & (first_n == 1)
    sc2 = (F.col("_ok1") == 0.0) & ~sc1
    per_cls = per_cls.select(*cls, "_r1", "_h1", sc1.alias("_sc1"), sc2.alias("_sc2"), "_minid")
    # level 3: per (key, entity) — anything picked by 1/2? smallest id
    per_grp = per_cls.groupBy(*grp).agg(
        F.sum(F.col("_sc1").cast("int") + F.col("_sc2").cast("int")).alias("_s12"),
        F.min("_minid").alias("sc3_min_id"))
    decided = keyed_join(per_cls.drop("_minid"), per_grp, grp)

    out = keyed_join(d, decided, cls, "inner")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    first = F.col(row_id).eqNullSafe(F.col("_r1")) & (F.col("_h") == F.col("_h1")) & (F.col("_copy") == 1)
    s1 = (first & F.col("_sc1")).cast("int")
    s2 = (first & F.col("_sc2")).cast("int")
    s3 = F.coalesce(first & (F.col(id_col) == F.col("sc3_min_id")) & (F.col("_s12") == 0),
                    F.lit(False)).cast("int")
    out = out.withColumns({"sc1_select": s1, "sc2_select": s2, "sc3_select": s3})
    return _finish(out, df, flag_col, keep_helpers)


def _with_diff(df: DataFrame, id_col: str, pred_col: str, id_map: dict[str, int]) -> DataFrame:
    return (df.withColumn("pred_min_id", id_map_column(id_map)[F.col(pred_col)])
            .withColumn("pred_min_id_diff", F.col(id_col) - F.col("pred_min_id")))


def _finish(out: DataFrame, df: DataFrame, flag_col: str, keep_helpers: bool) -> DataFrame:
    out = out.withColumn(flag_col, F.col("sc1_select") + F.col("sc2_select") + F.col("sc3_select"))
    keep = df.columns + (["pred_min_id", "pred_min_id_diff", "sc3_min_id", "sc1_select", "sc2_select",
                          "sc3_select"] if keep_helpers else []) + [flag_col]
    return out.select(*keep)


def survivors_check(selected: DataFrame, key, entity: str | None = None,
                    flag_col: str = "select_flag") -> DataFrame:
    """(key, entity) groups where the selector did not keep exactly one row."""
    grp = _keys(key) + ([entity] if entity else [])
    return (selected.groupBy(*grp).agg(F.count_if(F.col(flag_col) == 1).alias("n_kept"),
                                       F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_kept") != 1))


def merge_resolved(original: DataFrame, resolved: DataFrame, key, entity: str | None = None,
                   repeated: DataFrame | None = None) -> DataFrame:
    """Original rows whose (key, entity) occurs once and has no resolved row, plus all resolved rows.

    Same result as tagging the union and keeping ``count over (key, entity) == 1 or tag = predicted``.
    Only keys are counted (``repeated``: the keys that occur twice or more, if the caller has them); the
    original rows leave through one anti join with the repeated and resolved keys, which AQE
    broadcasts when that side measures small, so that the rows do not move.
    """
    grp = _keys(key) + ([entity] if entity else [])
    if repeated is None:
        repeated = original.groupBy(*grp).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    gone = repeated.select(*grp).unionByName(resolved.select(*grp))
    return semi_join(original, gone, grp, anti=True).unionByName(resolved.select(*original.columns))


__all__ = ["id_map_column", "select_predicted", "survivors_check", "merge_resolved"]
