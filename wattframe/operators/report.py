"""Report tables handed to a dashboard: top-k per group, trailing periods, daily entity metrics,
JSON hand-over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group: list[str], score: str, k: int, tie: list[str] | None = None,
                    rank_col: str = "rank") -> DataFrame:
    """Best ``k`` rows per group by ``score`` (desc), ties by ``tie`` (asc).

    ``row_number <= k`` is planned as a partial WindowGroupLimit before the shuffle: a group holding
    a third of all rows sends at most ``k`` rows per map task.
    """
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), *[F.col(c) for c in (tie or [])])
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def trailing_period(df: DataFrame, ts_col: str, period: str) -> DataFrame:
    """Rows in the last ``period`` (an interval text such as ``'7 days'``) before the newest row."""
    newest = df.select(F.max(ts_col)).scalar()
    return df.filter(F.col(ts_col) > newest - F.expr(f"INTERVAL {period}"))


def history_long(curve: DataFrame, model: str, round_col: str = "round") -> DataFrame:
    """Learning curve (one row per round, one column per metric) → (model, round, metric, value)."""
    metrics = [c for c in curve.columns if c != round_col]
    return curve.unpivot([round_col], metrics, "metric", "value").select(
        F.lit(model).alias("model"), round_col, "metric", "value")


def expectation_table(counts: dict, expected: dict) -> DataFrame:
    """(check, expected, actual, ok) for named row counts — ``counts`` maps a name to a DataFrame
    whose rows are counted (each a scalar subquery; nothing is collected row by row)."""
    first = None
    for name, df in counts.items():
        row = df.sparkSession.range(1).select(
            F.lit(name).alias("check"), F.lit(int(expected[name])).cast("long").alias("expected"),
            df.select(F.count(F.lit(1))).scalar().alias("actual"))
        first = row if first is None else first.unionByName(row)
    return first.withColumn("ok", F.col("expected") == F.col("actual"))


def trailing_periods(df: DataFrame, ts_col: str, periods: dict) -> DataFrame:
    """All trailing windows in one scan: each row is tagged with every period (name → interval text)
    it falls in, relative to the newest row — (period, row...) long form, nested windows share rows."""
    newest = df.select(F.max(ts_col)).scalar()
    tags = F.array(*[F.when(F.col(ts_col) > newest - F.expr(f"INTERVAL {iv}"), F.lit(name))
                     for name, iv in periods.items()])
    return (df.withColumn("period", F.explode(F.array_compact(tags)))
            .select("period", *df.columns))


TRAILING_PERIODS = {"1w": "7 days", "1m": "1 months", "3m": "3 months", "6m": "6 months", "1y": "1 years"}


def entity_daily_metric(df: DataFrame, ts_col: str, entity: str, metric: str, digits: int | None = None) -> DataFrame:
    """Daily mean of ``metric`` per entity (optionally rounded)."""
    m = F.avg(metric)
    return df.groupBy(F.col(entity), F.to_date(ts_col).alias("date")).agg(
        (m if digits is None else F.round(m, digits)).alias(f"avg_{metric}"))


def flatten_json(spark, path: str, schema, rename: dict | None = None, keep=None, order=None) -> DataFrame:
    """JSON file → flat table: declared schema, renamed, filtered, columns sorted."""
    df = spark.read.schema(schema).json(path)
    for a, b in (rename or {}).items():
        df = df.withColumnRenamed(a, b)
    if keep is not None:
        df = df.filter(keep)
    return df.select(*(order or sorted(df.columns)))


__all__ = ["history_long", "expectation_table", "top_k_per_group", "trailing_period", "trailing_periods", "TRAILING_PERIODS", "entity_daily_metric", "flatten_json"]
