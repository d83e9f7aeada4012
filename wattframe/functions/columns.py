"""Column-list helpers: dtype selection, renames, suffixes, null-propagating sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.schemas import normalise_name


def columns_of_type(df: DataFrame, *types: str, exclude: bool = False) -> list[str]:
    """Names of columns whose simple type is (or, with ``exclude``, is not) one of ``types``."""
    want = set(types)
    return [c for c, t in df.dtypes if (t in want) != exclude]


def rename_all(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename every column by position (one projection)."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def normalise_columns(df: DataFrame, keep_hyphen: bool = False) -> DataFrame:
    return df.toDF(*[normalise_name(c, keep_hyphen) for c in df.columns])


def entity_suffix(names: list[str], entity: str, sep: str = "_") -> list[str]:
    return [f"{n}{sep}{entity}" for n in names]


def null_propagating_sum(cols) -> Column:
    """Plain ``a + b + ...``: one null part nulls the total (this is the intended semantics)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return reduce(lambda a, b: a + b, cs)
