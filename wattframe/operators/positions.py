"""Exact row positions in a total order, without a window over the whole table.

Rows are dealt into ranges of the order and sorted there; each range counts its rows, and a row's position
is the number of rows in the ranges before plus its number in its own.  The only ordered sum runs over one
row per range.  Put columns that tell rows apart last in the order (ids): a hot leading value is then cut
into several ranges, and the positions are the same after every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattframe.session import cut_lineage

_LOCAL = 33  # bits of a row's number within its partition in monotonically_increasing_id


def with_positions(df: DataFrame, order: list[str], name: str = "position", total: str | None = None) -> DataFrame:
    """``df`` with each row's position from 0 in ascending ``order`` (nulls first); ``total`` adds the row count.

    Rows equal in all of ``order`` get neighbouring positions in no stated order.  An empty table stays empty.
    """
    if not order:
        raise ValueError("order needs at least one column")
    if {name, total} & set(df.columns):
        raise ValueError("the table already has a column of that name")
    keys = [F.col(c) for c in order]
    staged = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _LOCAL)
    sizes = staged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    local = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL) - 1))
    joined = staged.withColumn("_part", part).join(offsets, "_part")
    extra = [F.col("_total").alias(total)] if total else []
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + local).alias(name), *extra)


def position_label(position: Column, cuts: dict[str, tuple[int | None, int | None]]) -> Column:
    """The label of the half-open position range ``[low, high)`` that holds a row (None: open); else null."""
    out = None
    for label, (low, high) in cuts.items():
        inside = F.lit(True)
        if low is not None:
            inside = inside & (position >= low)
        if high is not None:
            inside = inside & (position < high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def positional_split(df: DataFrame, order: list[str], cuts: dict[str, tuple[int | None, int | None]], name: str = "split") -> DataFrame:
    """Rows in one of the position ranges of ``cuts``, with its label; ranges must not overlap."""
    spans = sorted((lo or 0, hi) for lo, hi in cuts.values())
    if any(hi is None or hi > nxt for (_, hi), (nxt, _) in zip(spans, spans[1:])):
        raise ValueError("position ranges overlap")
    at = "_position"
    return with_positions(df, order, at).withColumn(name, position_label(F.col(at), cuts)).filter(F.col(name).isNotNull()).drop(at)


def positional_folds(df: DataFrame, order: list[str], k: int, name: str = "fold") -> DataFrame:
    """``df`` with a fold from 0 to k - 1: consecutive rows, sizes differing by one at most, larger folds first."""
    if k < 2:
        raise ValueError("k must be at least 2")
    at, n = F.col("_position"), F.col("_rows")
    rest, size = n % k, F.floor(n / k)
    longer = rest * (size + 1)  # rows in the folds that have one more
    fold = F.when(at < longer, F.floor(at / (size + 1))).otherwise(rest + F.floor((at - longer) / F.greatest(size, F.lit(1))))
    return with_positions(df, order, "_position", "_rows").withColumn(name, fold.cast("int")).drop("_position", "_rows")


def concat_columns(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], how: str = "inner") -> DataFrame:
    """Both tables side by side, row by row in their orders.  ``how="full"`` keeps the longer table's rest."""
    if set(left.columns) & set(right.columns):
        raise ValueError("columns of both tables clash")
    a, b = with_positions(left, left_order, "_position"), with_positions(right, right_order, "_position")
    return a.join(b, "_position", how).drop("_position")


__all__ = ["with_positions", "position_label", "positional_split", "positional_folds", "concat_columns"]
