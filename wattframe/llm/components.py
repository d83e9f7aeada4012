"""Connected components of an undirected edge table by alternating stars.

Each round is two grouped minima (partial aggregation, so a hub collapses before the shuffle) and
two equi-joins with one row per node on one side, which AQE splits when a hub holds many edges.
Neighbour lists are never collected.  Rounds are written to the shared folder, so lineage stays
short and a lost executor recomputes one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written


def _edges(df: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node, loops left out."""
    u, v = F.col("u"), F.col("v")
    return df.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()


def _round(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # large star: every larger neighbour of u hangs from the smallest node u sees
    large = _edges(e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    # small star: every smaller neighbour of u, and u, hang from the smallest of them
    return _edges(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionByName(low.select("u", F.col("m").alias("v"))))


def _is_forest(e: DataFrame) -> bool:
    """True when every node hangs from exactly one root, and no root hangs from another."""
    parents = e.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    roots = e.select(F.col("v").alias("u")).distinct()
    seen = (parents.select("u", F.when(F.col("n") > 1, 2).otherwise(1).alias("w"))
            .unionByName(roots.withColumn("w", F.lit(1))).groupBy("u").agg(F.sum("w").alias("w")))
    return seen.filter(F.col("w") > 1).limit(1).count() == 0


def connected_components(pairs: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, component`` (smallest reachable node) for every node with an edge to another.

    Null ends and loops are ignored, repeated edges count once, an empty table gives no rows.  The
    number of rounds grows with the logarithm of the component diameter; there is no upper bound
    that would leave a component unfinished.
    """
    spark = pairs.sparkSession
    e, path = written(_edges(pairs.select(F.col(u).alias("u"), F.col(v).alias("v"))), "edges")
    while not _is_forest(e):
        e, following = written(_round(e), "edges")
        drop(spark, path)
        path = following
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
