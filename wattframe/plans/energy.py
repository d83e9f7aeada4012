"""The energy ⋈ weather table: generation totals, inner join on the hour, mean imputation, checks.

``energy`` is one row per hour (text key with UTC offset); ``weather_wide`` one row per hour with
``<measure>_<city>`` columns.  The join is a 1:1 equi-join on the hour, so Spark shuffles both sides
once on the key (or broadcasts one when AQE measures it small); imputation is one aggregation for the
means and one projection to fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions.columns import columns_of_type
from wattframe.operators.impute import impute_means
from wattframe.operators.profile import null_counts
from wattframe.operators.reshape import energy_totals, join_energy_weather
from wattframe.schemas import ENERGY_KEEP, ENERGY_TOTALS


def energy_weather_table(energy: DataFrame, weather_wide: DataFrame, energy_time: str = "time",
                         weather_time: str = "dt_iso", keep: list[str] = ENERGY_KEEP,
                         totals: dict = ENERGY_TOTALS, impute: bool = True,
                         add_time_columns: bool = True) -> DataFrame:
    e = energy_totals(energy, keep, totals)
    j = join_energy_weather(e, weather_wide, energy_time, weather_time, add_time_columns=add_time_columns)
    if not impute:
        return j
    cols = columns_of_type(j, "double")
    return impute_means(j, cols)


def null_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows with any null before and after imputation, side by side (two one-row aggregates)."""
    b = null_counts(before).select(F.col("__rows_with_null").alias("rows_with_null_before"))
    a = null_counts(after).select(F.col("__rows_with_null").alias("rows_with_null_after"))
    return b.select("rows_with_null_before", a.select("rows_with_null_after").scalar().alias("rows_with_null_after"))


__all__ = ["energy_weather_table", "null_report"]
