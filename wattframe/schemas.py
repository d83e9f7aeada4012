"""Declared schemas and fixed values of the energy / weather data model.

Everything under "FIXED VALUES" must equal the source material for results to agree: column names,
entity names, the class → smallest-id map, the day/night icon list, text repair rules, the parts of
each generation total, the classifier inputs and the forecast targets.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# FIXED VALUES (must match the source data model)
# ---------------------------------------------------------------------------------------------

ENERGY_MEASURES = [
    "generation biomass",
    "generation fossil brown coal/lignite",
    "generation fossil coal-derived gas",
    "generation fossil gas",
    "generation fossil hard coal",
    "generation fossil oil",
    "generation fossil oil shale",
    "generation fossil peat",
    "generation geothermal",
    "generation hydro pumped storage aggregated",
    "generation hydro pumped storage consumption",
    "generation hydro run-of-river and poundage",
    "generation hydro water reservoir",
    "generation marine",
    "generation nuclear",
    "generation other",
    "generation other renewable",
    "generation solar",
    "generation waste",
    "generation wind offshore",
    "generation wind onshore",
    "forecast solar day ahead",
    "forecast wind offshore eday ahead",
    "forecast wind onshore day ahead",
    "total load forecast",
    "total load actual",
    "price day ahead",
    "price actual",
]

# Energy columns kept for the joined table, in this order.
ENERGY_KEEP = [
    "time",
    "generation fossil brown coal/lignite",
    "generation fossil gas",
    "generation fossil hard coal",
    "generation fossil oil",
    "generation hydro pumped storage consumption",
    "generation hydro run-of-river and poundage",
    "generation hydro water reservoir",
    "generation biomass",
    "generation other renewable",
    "generation solar",
    "generation waste",
    "generation wind onshore",
    "generation nuclear",
    "generation other",
    "forecast solar day ahead",
    "forecast wind onshore day ahead",
    "total load forecast",
    "total load actual",
    "price day ahead",
    "price actual",
]

# Generation totals: name -> parts (sums of nullable columns: one null part nulls the total).
# Totals may refer to earlier totals; they are evaluated in this order.
ENERGY_TOTALS = {
    "gen_fossil_totals": ["generation fossil brown coal/lignite", "generation fossil gas",
                          "generation fossil hard coal", "generation fossil oil"],
    "gen_nuclear_totals": ["generation nuclear"],
    "gen_hydro_totals": ["generation hydro pumped storage consumption",
                         "generation hydro run-of-river and poundage",
                         "generation hydro water reservoir"],
    "gen_solar_totals": ["generation solar"],
    "gen_wind_totals": ["generation wind onshore"],
    "gen_waste_totals": ["generation biomass", "generation waste"],
    "gen_renewable_totals": ["generation other renewable", "gen_hydro_totals", "gen_solar_totals",
                             "gen_wind_totals", "gen_waste_totals"],
}

WEATHER_MEASURES = [
    ("temp", "double"), ("temp_min", "double"), ("temp_max", "double"), ("pressure", "double"),
    ("humidity", "double"), ("wind_speed", "double"), ("wind_deg", "double"), ("rain_1h", "double"),
    ("rain_3h", "double"), ("snow_3h", "double"), ("clouds_all", "double"), ("weather_id", "double"),
    ("weather_main", "string"), ("weather_description", "string"), ("weather_icon", "string"),
]

CITIES = ["Madrid", "Seville", "Bilbao", "Barcelona", "Valencia"]

# Short names used for the per-city duplicate count columns (counts_<short>).
CITY_SHORT = {"Madrid": "mad", "Seville": "sev", "Bilbao": "bil", "Valencia": "val", "Barcelona": "bar"}

# weather class -> smallest weather id of that class.
WEATHER_MIN_ID = {
    "clear": 800, "clouds": 801, "drizzle": 300, "dust": 731, "fog": 741, "haze": 721,
    "mist": 701, "rain": 500, "smoke": 711, "snow": 600, "squall": 771, "thunderstorm": 200,
}

# Icons that already carry a day ("d") / night ("n") suffix.
DAY_NIGHT_ICONS = ["01d", "01n", "02d", "02n", "03d", "03n", "04d", "04n", "09d", "09n",
                   "10d", "10n", "11d", "11n", "13d", "13n", "50d", "50n"]

# Description repair rules, applied in order: (literal pattern, replacement).
DESCRIPTION_RULES = [
    ("proximity", ""),
    ("shower sleet", " light shower sleet"),
    ("light light shower sleet", "light shower sleet"),
]

# Classifier inputs for the weather class.
CLASSIFIER_INPUTS = ["temp", "temp_min", "temp_max", "pressure", "humidity", "wind_speed",
                     "wind_deg", "rain_1h", "rain_3h", "snow_3h", "clouds_all"]

# Forecast target -> (prediction column, day-ahead forecast published by the grid operator).
FORECAST_TARGETS = {
    "price_actual": ("price_predicted", "price_day_ahead"),
    "total_load_actual": ("total_load_predicted", "total_load_forecast"),
    "gen_solar_totals": ("gen_solar_totals_predicted", "forecast_solar_day_ahead"),
    "gen_wind_totals": ("gen_wind_totals_predicted", "forecast_wind_onshore_day_ahead"),
}

# Columns set aside before modelling and re-attached to the test-year output.
SET_ASIDE = ["forecast_solar_day_ahead", "forecast_wind_onshore_day_ahead", "total_load_forecast",
             "price_day_ahead", "generation_solar", "generation_wind_onshore"]

# Boosted-tree settings chosen by the grid search, per target.
BEST_TREE_PARAMS = {
    "price_actual": {"learning_rate": 0.07, "max_depth": 7, "n_estimators": 500},
    "total_load_actual": {"learning_rate": 0.07, "max_depth": 7, "n_estimators": 500},
    "gen_solar_totals": {"learning_rate": 0.07, "max_depth": 6, "n_estimators": 500},
    "gen_wind_totals": {"learning_rate": 0.07, "max_depth": 5, "n_estimators": 500},
}
TREE_COMMON = {"min_child_weight": 4, "subsample": 0.7, "colsample_bytree": 0.7}
TREE_GRID = {"learning_rate": [0.03, 0.05, 0.07], "max_depth": [5, 6, 7]}

TEST_YEAR = 2018                                   # forecast year (UTC)
HISTORY_SPLITS = ["2017-01-01", "2018-01-01"]       # train < … ≤ validation < … ≤ test (UTC)
EXPECTED_HOURS = 35064          # 2015-01-01 .. 2018-12-31
EXPECTED_RESOLVED_ROWS = 2798   # duplicate hours resolved, five cities
BALANCED_CAP = 150
HISTORY_WINDOW = 24

# ---------------------------------------------------------------------------------------------


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(),
          "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t], True) for n, t in fields])


ENERGY_SCHEMA = _struct([("time", "string")] + [(c, "double") for c in ENERGY_MEASURES])
WEATHER_SCHEMA = _struct([("dt_iso", "string"), ("city_name", "string")] + WEATHER_MEASURES)


def normalise_name(name: str, keep_hyphen: bool = False) -> str:
    """Column name for files and SQL: blanks, slashes (and hyphens unless kept) become ``_``.

    The source kept hyphens when it wrote its file and renamed them away by position when it read
    the file back; doing it in one step here gives the declared joined-table names directly.
    """
    out = name.replace(" ", "_").replace("/", "_")
    return out if keep_hyphen else out.replace("-", "_")


def wide_weather_schema(cities=CITIES) -> T.StructType:
    fields = [("dt_iso", "string")]
    for city in cities:
        fields += [(f"{m}_{city}", t) for m, t in WEATHER_MEASURES]
    return _struct(fields)


def energy_totals_schema() -> T.StructType:
    return _struct([(c, "string" if c == "time" else "double") for c in ENERGY_KEEP]
                   + [(t, "double") for t in ENERGY_TOTALS])


def energy_weather_schema(cities=CITIES) -> T.StructType:
    base = [T.StructField(normalise_name(f.name), f.dataType, True) for f in energy_totals_schema()]
    wide = list(wide_weather_schema(cities).fields)
    tail = [T.StructField("date", T.DateType(), True), T.StructField("date_time", T.TimestampType(), True)]
    return T.StructType(base + wide + tail)
