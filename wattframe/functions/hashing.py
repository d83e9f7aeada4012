"""Repeatable pseudo-random columns from a hash of a key.

``md5`` is used because every SQL engine has it with the same output, so a sample, split or fold
chosen here can be re-derived in plain SQL.  Nothing depends on partition layout or on ``rand``:
the same rows are chosen on every run and after any task retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX8 = 16 ** 8


def _key_text(cols, seed) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.concat_ws(":", F.lit(str(seed)), *parts)


def stable_order_key(cols, seed: int | str = 42) -> Column:
    """Hex md5 of ``seed:key...`` — order by it (descending) for a repeatable shuffle."""
    return F.md5(_key_text(list(cols), seed))


def hash_fraction_below(cols, fraction: float, seed: int | str = 42) -> Column:
    """True for about ``fraction`` of the keys: first 8 hex digits of md5 < fraction · 16^8."""
    threshold = format(int(fraction * _HEX8), "08x") if fraction < 1 else "g"
    return F.substring(stable_order_key(cols, seed), 1, 8) < F.lit(threshold)


def hash_fold(cols, k: int, seed: int | str = 42) -> Column:
    """Fold number 0..k-1 from the first 8 hex digits of md5 (shuffled k-fold)."""
    h = F.conv(F.substring(stable_order_key(cols, seed), 1, 8), 16, 10).cast("long")
    return (h % F.lit(k)).cast("int")
