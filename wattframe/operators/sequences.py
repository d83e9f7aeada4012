"""Fixed-length history windows ("the previous 24 rows") for sequence models.

A running window over a time index without a partition key would move every row to one task.
Two distributed forms, both exact and both keeping windows inside a split:

* ``method="blocks"`` (default): rows are cut into blocks of ``block_size`` consecutive indexes;
  each block also receives the ``history`` rows before it (and the rows after it that a label
  needs) as a halo, and a bounded ROWS window inside each (split, block) builds the sequences.
  The shuffle carries the rows about once (1 + halo / block_size), window partitions are bounded by
  the block size, and the 24× output is produced after the shuffle, not shipped through it.
* ``method="explode"``: each row is sent to the ``history`` targets it feeds and grouped by target
  (every group exactly ``history`` rows).  Simple, but the shuffle carries ``history``× the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hour_index(df: DataFrame, ts_col: str, origin, unit_seconds: int = 3600, out_col: str = "idx") -> DataFrame:
    """Row index from time: whole units since ``origin`` (a gap-free calendar makes it positional)."""
    t = F.unix_seconds(F.col(ts_col).cast("timestamp"))
    o = F.unix_seconds((origin if hasattr(origin, "_jc") else F.lit(origin)).cast("timestamp"))
    return df.withColumn(out_col, F.floor((t - o) / F.lit(unit_seconds)).cast("long"))


def complete_grid(spark, start, n_units: int, unit_seconds: int = 3600, ts_col: str = "ts",
                  idx_col: str = "idx") -> DataFrame:
    """All ``n_units`` time points from ``start`` as a distributed range (no single-task explode)."""
    base = F.unix_seconds(F.lit(start).cast("timestamp"))
    return spark.range(0, n_units).select(
        F.col("id").alias(idx_col),
        F.timestamp_seconds(base + F.col("id") * F.lit(unit_seconds)).cast("timestamp_ntz").alias(ts_col))


def _unique(rows: str, idx: str):
    """True, or an error where the collected rows hold an index twice."""
    indexes = F.transform(rows, lambda s: s[idx])
    return F.when(F.size(F.array_distinct(indexes)) < F.size(indexes), F.raise_error(F.lit("a time index is repeated")).cast("boolean")).otherwise(True)


def build_sequences(df: DataFrame, idx_col: str, value_col: str, label_col: str, history: int = 24,
                    target_offset: int = 0, horizon: int = 1, split_col: str | None = None,
                    out_col: str = "history", method: str = "blocks", block_size: int = 8192) -> DataFrame:
    """For every target index ``i`` with a full history inside its split:

    * ``history``: the values of rows ``i-history … i-1`` in order (``array``),
    * ``label``: ``label_col`` at ``i + target_offset`` (or, with ``horizon > 1``, the array of the
      ``horizon`` labels ``i … i+horizon-1``).

    ``idx_col`` must be unique within a split (one row per time index); a repeated index raises.  A target
    is produced only when all the indexes it needs are present.
    """
    if method == "blocks":
        return _sequences_blocks(df, idx_col, value_col, label_col, history, target_offset, horizon,
                                 split_col, out_col, block_size)
    if method != "explode":
        raise ValueError("method must be 'blocks' or 'explode'")
    part = [split_col] if split_col else []
    lags = F.sequence(F.lit(1), F.lit(history))
    sent = (df.select(*part, F.col(idx_col).alias("_src"), F.col(value_col).alias("_v"))
            .withColumn("_lag", F.explode(lags))
            .withColumn("_tgt", F.col("_src") + F.col("_lag")))
    seq = (sent.groupBy(*part, "_tgt")
           .agg(F.sort_array(F.collect_list(F.struct(F.col("_src"), F.col("_v")))).alias("_s"))
           .filter(_unique("_s", "_src") & (F.size("_s") == history))
           .select(*part, F.col("_tgt").alias(idx_col), F.transform("_s", lambda s: s["_v"]).alias(out_col)))
    if horizon == 1:
        labels = df.select(*part, (F.col(idx_col) - F.lit(target_offset)).alias(idx_col),
                           F.col(label_col).alias("label"))
    else:
        steps = F.sequence(F.lit(0), F.lit(horizon - 1))
        ls = (df.select(*part, F.col(idx_col).alias("_src"), F.col(label_col).alias("_y"))
              .withColumn("_k", F.explode(steps)).withColumn("_tgt", F.col("_src") - F.col("_k")))
        labels = (ls.groupBy(*part, "_tgt")
                  .agg(F.sort_array(F.collect_list(F.struct("_src", "_y"))).alias("_l"))
                  .filter(F.size("_l") == horizon)
                  .select(*part, F.col("_tgt").alias(idx_col), F.transform("_l", lambda s: s["_y"]).alias("label")))
    out = seq.join(labels, part + [idx_col], "inner")
    if target_offset != 0 or horizon != 1:  # the label row is not the target row: the target must exist too
        out = out.join(df.select(*part, idx_col), part + [idx_col], "left_semi")
    return out


def _sequences_blocks(df, idx_col, value_col, label_col, history, target_offset, horizon, split_col, out_col,
                      block_size):
    fwd = target_offset + horizon - 1
    if block_size <= history + max(fwd, 0):
        raise ValueError("block_size must exceed history + label look-ahead")
    part = [split_col] if split_col else []
    idx = F.col(idx_col)
    pos = F.pmod(idx, F.lit(block_size))
    blk = F.floor(idx / F.lit(block_size)).cast("long")
    # core copy, plus halo copies for the next block (last `history` rows) and the previous block
    # (first `fwd` rows) — at most three copies of a row, usually one
    copies = [F.struct(blk.alias("_b"), F.lit(True).alias("_core"))]
    copies.append(F.when(pos >= block_size - history, F.struct((blk + 1).alias("_b"), F.lit(False).alias("_core"))))
    if fwd > 0:
        copies.append(F.when(pos < fwd, F.struct((blk - 1).alias("_b"), F.lit(False).alias("_core"))))
    rows = (df.select(*part, idx.alias("_i"), F.col(value_col).alias("_v"), F.col(label_col).alias("_y"),
                      F.filter(F.array(*copies), lambda c: c.isNotNull()).alias("_c"))
            .select(*part, "_i", "_v", "_y", F.explode("_c").alias("_c"))
            .select(*part, "_i", "_v", "_y", F.col("_c._b").alias("_b"), F.col("_c._core").alias("_core")))
    w = Window.partitionBy(*part, "_b").orderBy("_i")
    hist = F.collect_list(F.struct("_i", "_v")).over(w.rowsBetween(-history, -1))
    labs = F.collect_list(F.struct("_i", "_y")).over(w.rowsBetween(target_offset, fwd))
    again = F.when(F.lag("_i").over(w) == F.col("_i"), F.raise_error(F.lit("a time index is repeated")).cast("boolean")).otherwise(True)
    seq = rows.select(*part, "_i", "_core", hist.alias("_h"), labs.alias("_l"), again.alias("_once"))
    ok = (F.col("_once") & F.col("_core") & (F.size("_h") == history) & (F.col("_h")[0]["_i"] == F.col("_i") - history)
          & (F.size("_l") == horizon) & (F.element_at("_l", -1)["_i"] == F.col("_i") + fwd)
          & (F.col("_l")[0]["_i"] == F.col("_i") + target_offset))
    label = F.col("_l")[0]["_y"] if horizon == 1 else F.transform("_l", lambda s: s["_y"])
    return seq.filter(ok).select(*part, F.col("_i").alias(idx_col),
                                 F.transform("_h", lambda s: s["_v"]).alias(out_col), label.alias("label"))


__all__ = ["hour_index", "complete_grid", "build_sequences"]
