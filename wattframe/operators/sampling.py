"""Sampling and splitting, all repeatable (hash of a key, never ``rand`` + partition layout)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions.hashing import hash_fold, hash_fraction_below, stable_order_key
from wattframe.functions.time import year_range


def balanced_sample(df: DataFrame, class_col: str, n: int = 100, id_cols: list[str] | None = None,
                    seed: int = 42, keep_helpers: bool = False, by: list[str] | None = None,
                    order: str = "hash", buckets: int = 32) -> DataFrame:
    """At most ``n`` rows per class, chosen by a hash of ``id_cols`` (repeatable).

    ``row_number <= n`` over (class ordered by hash desc, then id) — the same rows as a dense rank
    when ids are unique, and a strict cap when they are not.  The limit is taken twice: per class and
    bucket of the id first, then per class.  Spark plans each as a ``WindowGroupLimit`` on both sides of
    its exchange, so a map task forwards at most ``n`` rows per class and bucket, a class holding a third
    of all rows is dealt over ``buckets`` tasks, and the last one sees at most ``buckets * n`` rows of it.
    """
    if class_col not in df.columns:
        raise ValueError(f"{class_col!r} is not a column of the frame")
    ids = id_cols or [c for c in df.columns if c != class_col]
    first = [F.col("unif").desc(), *[F.col(c) for c in ids]]
    w = Window.partitionBy(*(by or []), class_col).orderBy(*first)
    w_bucket = Window.partitionBy(*(by or []), class_col, "_bucket").orderBy(*first)
    if order not in ("hash", "random"):
        raise ValueError("order must be 'hash' or 'random'")
    # "random" orders by rand(seed) as a plain random sample would; its rows depend on the layout
    unif = stable_order_key(ids, seed) if order == "hash" else F.rand(seed)
    out = (df.withColumn("unif", unif)
           .withColumn("_bucket", F.pmod(F.xxhash64(*ids), F.lit(buckets)))
           .withColumn("_bucket_rank", F.row_number().over(w_bucket))
           .filter(F.col("_bucket_rank") <= n).drop("_bucket", "_bucket_rank")
           .withColumn("cat_rank", F.row_number().over(w))
           .filter(F.col("cat_rank") <= n))
    return out if keep_helpers else out.drop("unif", "cat_rank")


def hash_split(df: DataFrame, id_cols: list[str], fraction: float = 0.6, seed: int = 42,
               method: str = "hash"):
    """(first, second) with about ``fraction`` of the keys in the first.

    ``method="hash"`` (default) is a repeatable split on a hash of the key; ``method="random"`` is
    Spark's ``randomSplit(seed)``, whose rows depend on the partition layout of ``df``.
    """
    if method == "random":
        first, second = df.randomSplit([fraction, 1 - fraction], seed)
        return first, second
    inside = hash_fraction_below(id_cols, fraction, seed)
    return df.filter(inside), df.filter(~inside)


def split_label(id_cols: list[str], fraction: float = 0.6, seed: int = 42,
                names=("train", "test")) -> Column:
    return F.when(hash_fraction_below(id_cols, fraction, seed), F.lit(names[0])).otherwise(F.lit(names[1]))


def year_split(df: DataFrame, ts_col: str, test_year: int):
    """(train, test): rows outside / inside ``test_year`` — range predicates, pushed to the scan."""
    inside = year_range(ts_col, test_year)
    return df.filter(~inside | F.col(ts_col).isNull()), df.filter(inside)


def time_split_label(ts_col: str, boundaries: list, names=("train", "validation", "test")) -> Column:
    """Label rows by half-open time ranges: [.., b0) → names[0], [b0, b1) → names[1], [b1, ..) → names[2]."""
    c = F.col(ts_col)
    expr = None
    for b, name in zip(boundaries, names):
        lit = F.lit(b if not isinstance(b, str) else _dt.datetime.fromisoformat(b)).cast("timestamp_ntz")
        expr = F.when(c < lit, F.lit(name)) if expr is None else expr.when(c < lit, F.lit(name))
    return expr.otherwise(F.lit(names[len(boundaries)]))


def shuffled_folds(id_cols: list[str], k: int = 3, seed: int = 123) -> Column:
    """Shuffled k-fold assignment (fold 0..k-1) from a hash of the key."""
    return hash_fold(id_cols, k, seed)


def contiguous_folds(df: DataFrame, ts_col: str, k: int = 2) -> Column:
    """Unshuffled k-fold: k equal time spans between min and max of ``ts_col``.

    Min and max come in as one scalar subquery (one small aggregate), so the assignment stays a
    per-row expression — no global window, no row numbering on one task.  On a gap-free hourly
    calendar equal spans are equal row counts.
    """
    t = F.unix_micros(F.col(ts_col).cast("timestamp"))
    bounds = df.select(F.struct(F.min(t).alias("lo"), F.max(t).alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    span = hi - lo + F.lit(1)
    return F.least(F.floor((t - lo) * F.lit(k) / span), F.lit(k - 1)).cast("int")


__all__ = ["balanced_sample", "hash_split", "split_label", "year_split", "time_split_label",
           "shuffled_folds", "contiguous_folds"]
