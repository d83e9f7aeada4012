"""Profiling and duplicate detection on long (key, entity, measures...) tables.

All of these are single grouped aggregations (partial aggregation map-side, one shuffle on the
group key), so a key that holds a third of all rows is collapsed before it is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.text import clean_token, day_night_icon, normalised_equals, repair_text
from wattframe.operators.joins import semi_join
from wattframe.schemas import DAY_NIGHT_ICONS, DESCRIPTION_RULES


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def profile_categories(df: DataFrame, cols: list[str], count_col: str = "count") -> DataFrame:
    """Row count per combination of ``cols`` (class / id / description / icon profile)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(count_col))


def build_dictionary(df: DataFrame, id_col: str, class_col: str, desc_col: str, icon_col: str,
                     rules=DESCRIPTION_RULES, icons=DAY_NIGHT_ICONS, collapse: bool = True,
                     count_col: str = "count") -> DataFrame:
    """Normalised class dictionary: descriptions repaired, icons given a day/night suffix, counted.

    Counts are pre-aggregated on the raw combination first, so the text repair runs once per
    distinct combination rather than once per row.
    """
    raw = df.groupBy(id_col, class_col, desc_col, icon_col).agg(F.count(F.lit(1)).alias("_n"))
    fixed = raw.select(id_col, class_col,
                       repair_text(desc_col, rules, collapse).alias(desc_col),
                       day_night_icon(icon_col, icons).alias(icon_col), "_n")
    return (fixed.groupBy(id_col, class_col, desc_col, icon_col)
            .agg(F.count(F.lit(1)).alias(count_col), F.sum("_n").alias("n_rows")))


def duplicate_counts(df: DataFrame, key, entity: str, min_count: int = 2,
                     count_col: str = "n_rows") -> DataFrame:
    """(key..., entity, n) for every (key, entity) that occurs at least ``min_count`` times."""
    ks = _keys(key)
    return (df.groupBy(*ks, entity).agg(F.count(F.lit(1)).alias(count_col))
            .filter(F.col(count_col) >= min_count))


def duplicate_histogram(df: DataFrame, key, entity: str) -> DataFrame:
    """Count of counts: how many keys occur 1, 2, 3... times per entity."""
    ks = _keys(key)
    per_key = df.groupBy(*ks, entity).agg(F.count(F.lit(1)).alias("multiplicity"))
    return per_key.groupBy(entity, "multiplicity").agg(F.count(F.lit(1)).alias("n_keys"))


def duplicate_matrix(df: DataFrame, key, entity: str, entities: list[str],
                     names: dict[str, str] | None = None, min_count: int = 2,
                     all_entities: list[str] | None = None) -> DataFrame:
    """One row per key duplicated in at least one entity: ``counts_<name>`` per entity (0 when that
    entity's key is not repeated) and ``all_dupl`` (repeated in every entity of ``all_entities``,
    default all of ``entities``).

    One conditional aggregation grouped by key replaces one filtered group-count per entity plus a
    chain of full outer joins: one scan, one shuffle, no join.
    """
    ks = _keys(key)
    names = names or {e: e for e in entities}
    tmp = {e: f"__n{i}" for i, e in enumerate(entities)}
    g = df.groupBy(*ks).agg(*[F.count_if(F.col(entity) == F.lit(e)).alias(tmp[e]) for e in entities])
    repeated = {e: F.col(tmp[e]) >= min_count for e in entities}
    out = g.filter(reduce(lambda a, b: a | b, repeated.values())).select(
        *ks, *[F.when(repeated[e], F.col(tmp[e])).otherwise(F.lit(0)).cast("long").alias(f"counts_{names[e]}")
               for e in entities])
    every = all_entities or entities
    return out.withColumn("all_dupl", reduce(lambda a, b: a & b,
                                             [F.col(f"counts_{names[e]}") > 0 for e in every]))


def duplicate_profile(df: DataFrame, duplicated_keys: DataFrame, key, entity: str, entity_value: str,
                      class_col: str, count_col: str = "count") -> DataFrame:
    """Class counts of one entity's rows at the duplicated keys."""
    ks = _keys(key)
    rows = semi_join(df.filter(normalised_equals(entity, entity_value)), duplicated_keys, ks)
    return rows.groupBy(class_col).agg(F.count(F.lit(1)).alias(count_col))


def any_missing(df: DataFrame, cols: list[str] | None = None) -> Column:
    """True when any of ``cols`` is null (or NaN for floating columns) — what ``na.drop`` drops."""
    types = dict(df.dtypes)
    cols = cols or df.columns
    conds = [F.isnull(c) | F.isnan(c) if types[c] in ("double", "float") else F.isnull(c) for c in cols]
    return reduce(lambda a, b: a | b, conds)


def quality_checks(df: DataFrame, key, entity: str | None = None, entities: list[str] | None = None,
                   expected_keys: int | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """One-row data-quality report.

    n_rows, n_rows_with_null (what ``na.drop`` would remove), n_keys, n_key_entity, expected rows
    (keys × entities), complete flag, per-entity row counts and — when a duplicate table is given —
    the share of keys that are duplicated, as text ``"12.34%"``.

    Rows are first reduced to one row per (key, entity) with partial aggregation; the distinct
    counts then run on that reduced table instead of expanding every input row.
    """
    ks = _keys(key)
    grp = ks + ([entity] if entity else [])
    per = df.groupBy(*grp).agg(F.count(F.lit(1)).alias("_n"), F.count_if(any_missing(df)).alias("_nn"))
    aggs = [F.sum("_n").cast("long").alias("n_rows"), F.sum("_nn").cast("long").alias("n_rows_with_null"),
            F.count_distinct(*ks).alias("n_keys")]
    if entity:
        aggs.append(F.count(F.lit(1)).alias("n_key_entity"))
        for e in entities or []:
            aggs.append(F.coalesce(F.sum(F.when(F.col(entity) == F.lit(e), F.col("_n"))), F.lit(0))
                        .cast("long").alias(f"n_{e}"))
    out = per.agg(*aggs)
    n_ent = len(entities) if entities else 1
    out = out.withColumn("expected_rows", (F.col("n_keys") * F.lit(n_ent)).cast("long"))
    out = out.withColumn("complete", F.col("n_rows") == F.col("expected_rows"))
    if expected_keys is not None:
        out = out.withColumn("expected_keys", F.lit(expected_keys).cast("long"))
        out = out.withColumn("keys_as_expected", F.col("n_keys") == F.lit(expected_keys))
    if duplicates is not None:
        denom = F.lit(float(expected_keys)) if expected_keys else F.col("n_keys").cast("double")
        n_dup = duplicates.select(F.count(F.lit(1))).scalar()
        out = (out.withColumn("n_duplicated_keys", n_dup)
               .withColumn("duplicated_share", F.format_string("%.2f%%", n_dup / denom * 100)))
    return out


def null_counts(df: DataFrame) -> DataFrame:
    """Rows with any null/NaN, and null count per column, in one pass."""
    types = dict(df.dtypes)
    per_col = [F.count_if(F.isnull(c) | F.isnan(c) if types[c] in ("double", "float") else F.isnull(c)).alias(c)
               for c in df.columns]
    return df.agg(F.count_if(any_missing(df)).alias("__rows_with_null"), *per_col)


__all__ = ["profile_categories", "build_dictionary", "duplicate_counts", "duplicate_histogram",
           "duplicate_matrix", "duplicate_profile", "any_missing", "quality_checks", "null_counts",
           "clean_token"]
