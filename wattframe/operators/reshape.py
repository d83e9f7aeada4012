"""Reshaping: long → wide per entity, generation totals, the energy ⋈ weather table, wide → long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.columns import null_propagating_sum
from wattframe.functions.time import OFFSET_PATTERN
from wattframe.schemas import ENERGY_KEEP, ENERGY_TOTALS, normalise_name


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


_AGGS = {"min": F.min, "max": F.max, "first": lambda c: F.first(c, ignorenulls=True),
         "avg": F.avg, "sum": F.sum}


def to_wide(df: DataFrame, key, entity: str, entities: list[str], measures: list[str] | None = None,
            agg: str = "min", suffix=None, dictionaries: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per key; column ``<measure>_<entity>`` for every measure and entity.

    Written as one conditional aggregation grouped by key (one shuffle, partial aggregation), not as
    one left join per entity.  Every key present for any entity appears once; an entity without a row
    for that key gives NULLs.  With one row per (key, entity) — the resolved table — ``agg`` does not
    matter; with repeats it decides which value wins (``min`` is deterministic).

    Text measures mean a sort-based aggregation (no fixed-width buffer for strings).  Where the caller
    knows all values of a text measure, ``dictionaries`` names them: the measure is then aggregated as
    its position in the sorted list and decoded afterwards, so the pivot stays a hash aggregation.  The
    result is the same (``min`` / ``max`` of positions equal those of the text); a value that is not in
    the list raises.
    """
    ks = _keys(key)
    measures = measures or [c for c in df.columns if c not in ks and c != entity]
    suffix = suffix or (lambda e: e)
    f = _AGGS[agg]
    dicts = {m: sorted(set(v)) for m, v in (dictionaries or {}).items() if m in measures}
    if dicts and agg not in ("min", "max", "first"):
        raise ValueError(f"a text measure can't be aggregated by {agg!r}")

    def coded(m):
        at = F.array_position(F.array(*[F.lit(v) for v in dicts[m]]), F.col(m)).cast("int")
        unknown = F.raise_error(F.concat(F.lit(f"{m}: not in its dictionary: "), F.col(m))).cast("int")
        return F.when(at == 0, unknown).otherwise(at).alias(m)

    src = df.select(*ks, entity, *[coded(m) if m in dicts else F.col(m) for m in measures]) if dicts else df
    names = {f"{m}_{suffix(e)}": (m, e) for e in entities for m in measures}
    out = src.groupBy(*ks).agg(*[f(F.when(F.col(entity) == F.lit(e), F.col(m))).alias(c) for c, (m, e) in names.items()])
    if not dicts:
        return out
    # explicit null guard: element_at over a nullable aggregate result has been seen to ignore the
    # index's null flag when evaluated inside the aggregation's result projection
    return out.select(*ks, *[
        F.when(F.col(c).isNotNull(), F.element_at(F.array(*[F.lit(v) for v in dicts[m]]), F.col(c))).alias(c) if m in dicts else F.col(c)
        for c, (m, _) in names.items()])


def to_long(df: DataFrame, key, columns: list[str], name_col: str = "series",
            value_col: str = "value") -> DataFrame:
    """Wide → long (``unpivot``): one row per key and column."""
    return df.unpivot(_keys(key), columns, name_col, value_col)


def totals_columns(totals: dict[str, list[str]]) -> dict[str, Column]:
    """Expand totals that refer to earlier totals into plain sums of base columns."""
    expanded: dict[str, list[str]] = {}
    for name, parts in totals.items():
        flat: list[str] = []
        for p in parts:
            flat.extend(expanded.get(p, [p]))
        expanded[name] = flat
    return {name: null_propagating_sum(parts) for name, parts in expanded.items()}


def energy_totals(df: DataFrame, keep: list[str] = ENERGY_KEEP,
                  totals: dict[str, list[str]] = ENERGY_TOTALS) -> DataFrame:
    """Select ``keep`` and add the group totals, all in one projection."""
    tc = totals_columns(totals)
    return df.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in tc.items()])


def join_energy_weather(energy: DataFrame, weather: DataFrame, energy_time: str = "time",
                        weather_time: str = "dt_iso", time_pattern: str = OFFSET_PATTERN,
                        add_time_columns: bool = True) -> DataFrame:
    """Inner equi-join on the hour (differently named keys, both kept), names normalised,
    ``date`` and ``date_time`` parsed from the energy time text (month-correct pattern)."""
    j = energy.join(weather, energy[f"`{energy_time}`"] == weather[f"`{weather_time}`"], "inner")
    j = j.toDF(*[normalise_name(c) for c in j.columns])
    if add_time_columns:
        t = normalise_name(energy_time)
        ts = F.to_timestamp(F.col(t), time_pattern)
        j = j.withColumns({"date": F.to_date(ts), "date_time": ts})
    return j


__all__ = ["to_wide", "to_long", "totals_columns", "energy_totals", "join_energy_weather"]
