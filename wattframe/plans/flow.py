"""The whole data-preparation flow on the energy / weather files, as one call.

``build_tables`` reads the two hourly CSV files with their declared schemas, trims city names,
resolves repeated (hour, city) weather rows, turns weather wide, joins it to the energy totals,
imputes means and writes the outputs (Parquet by default, partitioned by year so later year
filters prune whole directories).  It returns the DataFrames and the checks: a quality report of
the resolved long table, the (hour, city) groups where the selector kept other than one row, and a
one-row-per-check expectation table.  Every step is one of the library operators; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.functions.time import parse_offset_timestamp
from wattframe.operators.impute import drop_incomplete
from wattframe.operators.profile import duplicate_matrix, quality_checks
from wattframe.operators.report import expectation_table
from wattframe.plans.energy import energy_weather_table
from wattframe.operators.resolve import survivors_check
from wattframe.plans.weather import resolve_duplicates, wide_weather
from wattframe.schemas import (CITIES, CLASSIFIER_INPUTS, CITY_SHORT, ENERGY_SCHEMA, EXPECTED_HOURS, EXPECTED_RESOLVED_ROWS,
                               WEATHER_MIN_ID, WEATHER_SCHEMA, WEATHER_MEASURES)
from wattframe.session import cut_lineage
from wattframe.sources.files import read_csv, write_csv, write_parquet


def load_weather(spark: SparkSession, path: str) -> DataFrame:
    w = read_csv(spark, path, WEATHER_SCHEMA)
    return w.withColumn("city_name", F.trim("city_name"))


def load_energy(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ENERGY_SCHEMA)


def with_row_id(weather: DataFrame) -> DataFrame:
    """Row id for tie-breaking: ``xxhash64`` of the whole row — a narrow projection, the same on every
    run and after any retry or repartitioning, unlike positional ids.  Byte-identical copies share an
    id; the selector counts them as peers of one another."""
    return weather.withColumn("row_id", F.xxhash64(*[F.col(c) for c in weather.columns]))


def build_tables(spark: SparkSession, energy_path: str, weather_path: str, out_dir: str | None = None,
                 cities: list[str] = CITIES, fmt: str = "parquet", expected_hours: int | None = EXPECTED_HOURS,
                 expected_resolved: int | None = EXPECTED_RESOLVED_ROWS):
    energy = load_energy(spark, energy_path)
    # the text file is parsed once; all passes below read columns of the copy in the shared folder
    weather = cut_lineage(with_row_id(load_weather(spark, weather_path)))
    raw = weather.drop("row_id")
    selected, merged = resolve_duplicates(weather, "dt_iso", "city_name", cities, CLASSIFIER_INPUTS,
                                          "weather_main", "weather_id", WEATHER_MIN_ID, "row_id")
    # read by the pivot and the quality report
    merged = cut_lineage(merged.drop("row_id"))
    measures = [m for m, _ in WEATHER_MEASURES]
    # read by the imputer's fit, the joined table, the sink and the check
    wide = cut_lineage(wide_weather(merged.select("dt_iso", "city_name", *measures), "dt_iso", "city_name", cities, measures))
    table = energy_weather_table(energy, wide)
    resolved_rows = selected.filter(F.col("select_flag") == 1).drop("row_id", "select_flag")
    dups = duplicate_matrix(raw, "dt_iso", "city_name", cities, names=CITY_SHORT)
    checks = {"weather": quality_checks(merged, "dt_iso", "city_name", cities, expected_hours, dups),
              "survivors": survivors_check(selected, "dt_iso", "city_name")}
    if expected_hours is not None:
        counted = {"joined_complete_rows": (drop_incomplete(table), expected_hours),
                   "wide_complete_rows": (drop_incomplete(wide), expected_hours)}
        if expected_resolved is not None:
            counted["resolved_complete_rows"] = (drop_incomplete(resolved_rows), expected_resolved)
        checks["expectations"] = expectation_table({k: df for k, (df, _) in counted.items()}, {k: n for k, (_, n) in counted.items()})
    if out_dir:
        out = out_dir.rstrip("/")
        if fmt == "csv":
            write_csv(resolved_rows, f"{out}/predicted_weather", mode="overwrite")
            write_csv(wide, f"{out}/weather_wide", mode="overwrite")
            write_csv(table, f"{out}/energy_weather", mode="overwrite")
        else:
            year = F.year(parse_offset_timestamp("dt_iso"))
            write_parquet(resolved_rows, f"{out}/predicted_weather", mode="overwrite")
            write_parquet(wide.withColumn("year", year), f"{out}/weather_wide", mode="overwrite", partition_by=["year"])
            write_parquet(table.withColumn("year", F.year("date_time")), f"{out}/energy_weather", mode="overwrite",
                          partition_by=["year"])
    return {"predicted": resolved_rows, "merged": merged, "weather_wide": wide, "energy_weather": table,
            "checks": checks}


__all__ = ["load_weather", "load_energy", "with_row_id", "build_tables"]
