"""Join helpers.

Every join here is an equi-join, so Spark can choose hash / sort-merge / broadcast itself.  Aggregated
sides (one row per key) are joined back to row-level data; AQE turns them into broadcast joins at run
time when their *measured* size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and splits
hot keys of the big side otherwise.  Nothing is broadcast on a guess.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cond(left: DataFrame, right: DataFrame, keys, rkeys, null_safe: bool):
    parts = []
    for k, rk in zip(keys, rkeys):
        parts.append(left[k].eqNullSafe(right[rk]) if null_safe else left[k] == right[rk])
    return reduce(lambda a, b: a & b, parts)


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
               null_safe: bool = True) -> DataFrame:
    """Join on same-named ``keys``; null keys match each other when ``null_safe`` (like GROUP BY).

    The right side's key columns are dropped from the output, as with ``join(on=[names])``.
    """
    rkeys = [f"__rk_{i}" for i in range(len(keys))]
    r = right.select(*[F.col(k).alias(rk) for k, rk in zip(keys, rkeys)],
                     *[c for c in right.columns if c not in keys])
    out = left.join(r, _cond(left, r, keys, rkeys, null_safe), how)
    if how in ("left_semi", "semi", "leftsemi", "left_anti", "anti", "leftanti"):
        return out
    return out.drop(*rkeys)


def semi_join(left: DataFrame, right: DataFrame, keys: list[str], anti: bool = False,
              null_safe: bool = True) -> DataFrame:
    """Rows of ``left`` whose key is (``anti``: is not) in ``right`` — EXISTS / NOT EXISTS."""
    return keyed_join(left, right.select(*keys), keys, "left_anti" if anti else "left_semi", null_safe)
