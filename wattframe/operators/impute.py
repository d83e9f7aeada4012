"""Missing values: mean imputation, dropping incomplete rows, zero fill."""

from __future__ import annotations

from pyspark.ml.feature import Imputer, ImputerModel
from pyspark.sql import DataFrame

from wattframe.functions.columns import columns_of_type


def fit_means(df: DataFrame, cols: list[str] | None = None) -> ImputerModel:
    """Column means (nulls and NaN skipped) — one aggregation job; only d numbers reach the driver."""
    cols = cols or columns_of_type(df, "double", "float")
    return Imputer(strategy="mean", inputCols=cols, outputCols=cols).fit(df)


def impute_means(df: DataFrame, cols: list[str] | None = None, model: ImputerModel | None = None) -> DataFrame:
    """Replace null/NaN in every double column (or ``cols``) by the column mean; names and order kept.

    A column with no value at all has no mean: Spark raises, which is what we want — drop or fill
    such columns explicitly first.
    """
    cols = cols or columns_of_type(df, "double", "float")
    if not cols:
        return df
    model = model or fit_means(df, cols)
    return model.transform(df).select(*df.columns)


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows without null (or NaN) in ``cols`` (default: all columns)."""
    return df.na.drop(how="any", subset=cols)


def fill_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric null/NaN → 0 (booleans and strings untouched)."""
    return df.na.fill(0, subset=cols) if cols else df.na.fill(0)


__all__ = ["fit_means", "impute_means", "drop_incomplete", "fill_zero"]
