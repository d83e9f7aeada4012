"""Feature operators: calendar parts, model-input frame, label indexing, min-max scaling, centred PCA.

Fitting an operator (scaler range, PCA basis, label order) is one distributed aggregation whose small
result (d numbers, a d×d matrix, k labels) is what reaches the driver; transforming is a per-row
column expression (or a Spark ML transformer), so it runs inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import IndexToString, PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions.columns import columns_of_type
from wattframe.functions.time import calendar_parts
from wattframe.schemas import SET_ASIDE


def calendar_features(df: DataFrame, ts_col: str, drop: list[str] | None = None,
                      numeric_only: bool = True) -> DataFrame:
    """Add hour, weekday (Monday = 0), month, year (UTC, doubles); drop ``drop``; keep numerics + key."""
    out = df.withColumns(calendar_parts(ts_col))
    drop = [c for c in (drop or []) if c in out.columns]
    out = out.drop(*drop)
    if numeric_only:
        numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
        keep = [ts_col] + [c for c, t in out.dtypes if c != ts_col and (t in numeric or t.startswith("decimal"))]
        out = out.select(*keep)
    return out


def model_input(df: DataFrame, ts_col: str, drop: list[str] = SET_ASIDE) -> DataFrame:
    return calendar_features(df, ts_col, drop=drop, numeric_only=True)


def set_aside(df: DataFrame, ts_col: str, cols: list[str]) -> DataFrame:
    """The column block set aside before modelling, keyed by time, for re-attachment by join."""
    return df.select(ts_col, *cols)


def fit_label_index(df: DataFrame, label_col: str, out_col: str = "label_idx"):
    """Labels ordered by frequency (desc), ties by label (asc) — Spark's StringIndexer order."""
    return StringIndexer(inputCol=label_col, outputCol=out_col, stringOrderType="frequencyDesc",
                         handleInvalid="keep").fit(df)


def index_to_label(model, idx_col: str, out_col: str) -> IndexToString:
    return IndexToString(inputCol=idx_col, outputCol=out_col, labels=model.labels)


@dataclass
class MinMaxModel:
    """Per-column min and max fitted on a training range; ``lo``/``hi`` are the target range."""
    mins: dict
    maxs: dict
    lo: float = 0.0
    hi: float = 1.0

    @property
    def columns(self) -> list[str]:
        return list(self.mins)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        cols = {}
        for c in self.columns:
            scale = (self.hi - self.lo) / (self.maxs[c] - self.mins[c])
            cols[c + suffix] = (F.col(c) - F.lit(self.mins[c])) * F.lit(scale) + F.lit(self.lo)
        return df.withColumns(cols)

    def inverse_column(self, col, name: str):
        """Scaled value → original units."""
        c = F.col(col) if isinstance(col, str) else col
        span = self.maxs[name] - self.mins[name]
        return (c - F.lit(self.lo)) / F.lit(self.hi - self.lo) * F.lit(span) + F.lit(self.mins[name])

    def inverse_error(self, col, name: str):
        """Scaled error / RMSE → original units (a difference scales by the factor only)."""
        c = F.col(col) if isinstance(col, str) else col
        return c / F.lit(self.hi - self.lo) * F.lit(self.maxs[name] - self.mins[name])


def fit_minmax(train: DataFrame, cols: list[str] | None = None, lo: float = 0.0, hi: float = 1.0,
               drop_constant: bool = True) -> MinMaxModel:
    """One aggregation over the training rows; columns with zero range are left out when
    ``drop_constant`` (they carry no information and map differently in different libraries)."""
    cols = cols or columns_of_type(train, "double", "float", "int", "bigint")
    row = train.agg(*[F.min(c).alias(f"mn{i}") for i, c in enumerate(cols)],
                    *[F.max(c).alias(f"mx{i}") for i, c in enumerate(cols)]).first()
    mins, maxs = {}, {}
    for i, c in enumerate(cols):
        mn, mx = row[f"mn{i}"], row[f"mx{i}"]
        if mn is None or (mx == mn and drop_constant):
            continue
        if mx == mn:
            raise ValueError(f"column {c!r} is constant on the training rows")
        mins[c], maxs[c] = float(mn), float(mx)
    return MinMaxModel(mins, maxs, lo, hi)


@dataclass
class CentredPCA:
    """Centre on the training mean, then project on the first k principal axes."""
    scaler: object
    pca: object
    k: int
    explained: list

    def transform(self, df: DataFrame, in_col: str = "features", out_col: str = "pca") -> DataFrame:
        c = self.scaler.transform(df).drop(in_col).withColumnRenamed("__centred", in_col)
        scores = vector_to_array(F.col("__scores"))
        return (self.pca.copy({self.pca.outputCol: "__scores"}).transform(c)
                .withColumn(out_col, array_to_vector(F.slice(scores, 1, self.k))).drop("__scores"))


def fit_centred_pca(train: DataFrame, in_col: str = "features", out_col: str = "pca",
                    variance: float = 0.80) -> CentredPCA:
    """PCA keeping the fewest components whose cumulative explained variance reaches ``variance``.

    Spark computes the covariance with a distributed tree aggregation; only the d×d matrix reaches
    the driver.  Centring first makes the scores match the usual (mean-removed) definition.
    """
    scaler = StandardScaler(inputCol=in_col, outputCol="__centred", withMean=True, withStd=False).fit(train)
    centred = scaler.transform(train).drop(in_col).withColumnRenamed("__centred", in_col)
    d = len(centred.select(in_col).first()[0])
    full = PCA(k=d, inputCol=in_col, outputCol=out_col).fit(centred)
    ev = list(full.explainedVariance.toArray())
    k = int(np.searchsorted(np.cumsum(ev), variance - 1e-12) + 1)
    return CentredPCA(scaler, full, min(k, d), ev)


#: Partitions of a training frame.  Part of a seeded model's definition, like its seed: raise it for
#: frames that need more than a few hundred MB per partition.
FIT_PARTITIONS = 8


def stable_layout(df: DataFrame, order: list[str], partitions: int = FIT_PARTITIONS) -> DataFrame:
    """Give a training frame a partition layout that does not depend on upstream partitioning.

    Seeded learners draw per partition (bagging, row subsampling), so the same rows in another
    layout give another model.  Rows are dealt by a hash of ``order`` into ``partitions`` and sorted
    there, at every size alike; ``order`` should identify a row.
    """
    return df.repartition(partitions, *order).sortWithinPartitions(*order)


def assemble(df: DataFrame, cols: list[str], out_col: str = "features", handle_invalid: str = "error") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out_col, handleInvalid=handle_invalid).transform(df)


def vector_columns(df: DataFrame, vec_col: str, prefix: str) -> DataFrame:
    """Vector → array<double> (JVM-side), for array expressions or SQL."""
    return df.withColumn(prefix, vector_to_array(F.col(vec_col)))


__all__ = ["FIT_PARTITIONS", "stable_layout", "calendar_features", "model_input", "set_aside", "fit_label_index", "index_to_label",
           "MinMaxModel", "fit_minmax", "CentredPCA", "fit_centred_pca", "assemble", "vector_columns"]
