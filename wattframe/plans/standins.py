"""How the driver's test tables play the energy / weather data model.

* ``events`` is the long weather table: ``slot`` (``ts`` truncated to the minute — rare repeats) or
  ``hour`` (truncated to the hour — frequent repeats) is the time key, ``event_type`` the entity
  (city), ``value`` a measure.  The weather class is a band of ``value`` and the class id its floor,
  so each class has a smallest id like the weather classes do.
* ``lineitem`` is the numeric energy table (parts → totals, per-row imputation); its daily
  aggregate over ``l_shipdate`` is the time series the forecasters run on; ``orders`` aggregated per
  ``o_orderdate`` is the second table joined on the time key.
* ``embeddings`` is the vector set for scaling, PCA and classifiers; ``part`` serves text functions.

Each function returns a lazy DataFrame over the whole table.  ``SQL`` holds the same derivations as
SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.functions.time import hour_key
from wattframe.sources.files import read_table

# ---------------------------------------------------------------------------------------------
# FIXED VALUES of the stand-in model (class bands of events.value and their smallest ids)
# ---------------------------------------------------------------------------------------------
EVENT_ENTITIES = ["click", "error", "purchase", "signup", "view"]
VALUE_BANDS = [(10, "low"), (30, "mid"), (80, "high")]   # below each bound; the rest is "peak"
TOP_BAND = "peak"
BAND_MIN_ID = {"low": 0, "mid": 10, "high": 30, "peak": 80}
USER_BANDS = [(10, "low"), (30, "mid"), (80, "high"), (140, "peak")]  # predicted class from user_id
UNKNOWN_CLASS = "unknown"
# ---------------------------------------------------------------------------------------------


def band(col, bands, top):
    c = F.col(col)
    expr = None
    for bound, name in bands:
        expr = F.when(c < bound, F.lit(name)) if expr is None else expr.when(c < bound, F.lit(name))
    return expr.otherwise(F.lit(top))


def band_sql(col, bands, top) -> str:
    whens = " ".join(f"WHEN {col} < {b} THEN '{n}'" for b, n in bands)
    return f"CASE {whens} ELSE '{top}' END"


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts",
        hour_key("ts", "minute").alias("slot"),
        hour_key("ts", "hour").alias("hour"),
        F.col("event_type").alias("entity"),
        "value", "user_id",
        band("value", VALUE_BANDS, TOP_BAND).alias("cls"),
        F.floor("value").cast("double").alias("cls_id"),
        band("user_id", USER_BANDS, UNKNOWN_CLASS).alias("pred_cls"),
        "props",
    )


EVENTS_LONG_SQL = f"""
SELECT event_id, ts, date_trunc('minute', ts) AS slot, date_trunc('hour', ts) AS hour,
       event_type AS entity, value, user_id,
       {band_sql('value', VALUE_BANDS, TOP_BAND)} AS cls,
       CAST(floor(value) AS DOUBLE) AS cls_id,
       {band_sql('user_id', USER_BANDS, UNKNOWN_CLASS)} AS pred_cls
FROM events
"""


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series from lineitem: the stand-in for the hourly energy table (one row per day)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_shipdate").alias("day")).agg(
        F.sum("l_quantity").alias("quantity"),
        F.sum("l_extendedprice").alias("price"),
        F.sum("l_discount").alias("discount"),
        F.sum("l_tax").alias("tax"),
        F.count(F.lit(1)).cast("double").alias("lines"),
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("returns"))


LINEITEM_DAILY_SQL = """
SELECT l_shipdate AS day, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price,
       sum(l_discount) AS discount, sum(l_tax) AS tax, CAST(count(*) AS DOUBLE) AS lines,
       CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS returns
FROM lineitem GROUP BY l_shipdate
"""


def lineitem_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem numeric parts with deterministic holes (quantity on line 1, discount on line 2)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_linenumber") == 2, F.lit(None)).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax")


LINEITEM_GAPS_SQL = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS l_quantity,
       l_extendedprice, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS l_discount, l_tax
FROM lineitem
"""

# FIXED VALUES of the stand-in text / icon rules (same shape as the weather description chain)
PART_NAME_RULES = [("small", ""), ("ring", " big ring"), ("big big ring", "big ring")]
PART_KNOWN_BRANDS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"]
TOTALS_SPEC = {"t_rate": ["l_discount", "l_tax"], "t_price": ["l_extendedprice", "l_quantity"],
               "t_all": ["t_rate", "t_price"]}


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly aggregate of events: the stand-in for an hourly feature table (x = rows, y = value)."""
    ev = read_table(spark, sf_dir, "events", ["ts", "value"])
    return ev.groupBy(hour_key("ts").alias("hour")).agg(F.count(F.lit(1)).cast("double").alias("x"),
                                                      F.sum("value").alias("y"))


HOURLY_EVENTS_SQL = """
SELECT date_trunc('hour', ts) AS hour, CAST(count(*) AS DOUBLE) AS x, sum(value) AS y FROM events GROUP BY 1
"""

# FIXED VALUES: energy-table stand-in (lineitem per day) and its weather-table stand-in (orders per
# day and priority: the five priorities play the five cities)
DAILY_KEEP = ["time", "quantity", "price", "discount", "tax", "lines", "returns"]
DAILY_TOTALS = {"t_value": ["price", "quantity"], "t_rates": ["discount", "tax"], "t_all": ["t_value", "t_rates"]}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ORDER_MEASURES = ["o_totalprice", "o_orderstatus"]


def offset_text(col):
    return F.concat(F.date_format(col, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))


def daily_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lineitem_daily(spark, sf_dir)
    return d.select(offset_text("day").alias("time"), *[c for c in DAILY_KEEP if c != "time"])


def orders_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority", *ORDER_MEASURES])
    return o.select("o_orderkey", offset_text("o_orderdate").alias("dt_iso"),
                    F.col("o_orderpriority").alias("priority"), *ORDER_MEASURES)


def daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem per day with calendar parts: the model-input stand-in (key ``day``)."""
    from wattframe.operators.features import calendar_features
    return calendar_features(lineitem_daily(spark, sf_dir), "day")


# FIXED VALUES: event types → cities, value bands → weather classes (id base, description, icon)
EVENT_CITY = {"click": "Madrid", "error": "Seville", "purchase": "Bilbao", "signup": "Barcelona", "view": "Valencia"}
VALUE_WEATHER = [(10, "clear", 800, "sky is clear", "01d"), (30, "clouds", 801, "few clouds", "02d"),
                 (80, "rain", 500, "light rain", "10d")]
TOP_WEATHER = ("mist", 701, "mist", "50d")


def flow_inputs(spark: SparkSession, sf_dir: str):
    """(energy, weather) in the source file schemas, derived from ``events``.

    Weather: one row per event — time key = the event's minute as offset text, city = its type,
    measures from value / user id / props, class and id from the value band (repeats per (time,
    city) come from the data).  Energy: one row per time key, the 28 measures as fixed linear
    functions of that key's event count and value sum (one missing part per key with a single
    event, so imputation has work).
    """
    from wattframe.schemas import ENERGY_MEASURES
    ev = read_table(spark, sf_dir, "events")
    key = offset_text(hour_key("ts", "minute"))
    v = F.col("value")
    k = F.get_json_object("props", "$.k").cast("double")
    city = F.create_map(*[x for kv in EVENT_CITY.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])[F.col("event_type")]

    def by_band(i):
        expr = None
        for bound, *vals in VALUE_WEATHER:
            expr = F.when(v < bound, F.lit(vals[i])) if expr is None else expr.when(v < bound, F.lit(vals[i]))
        return expr.otherwise(F.lit(TOP_WEATHER[i]))

    weather = ev.select(
        key.alias("dt_iso"), F.concat(F.lit(" "), city).alias("city_name"),
        (v / 10).alias("temp"), (v / 10 - 1).alias("temp_min"), (v / 10 + 1).alias("temp_max"),
        (F.lit(1000.0) + F.col("user_id")).alias("pressure"), k.alias("humidity"), (v / 100).alias("wind_speed"),
        (F.col("user_id") * 2.0).alias("wind_deg"), F.when(v < 5, v).otherwise(F.lit(0.0)).alias("rain_1h"),
        F.lit(0.0).alias("rain_3h"), F.lit(0.0).alias("snow_3h"), k.alias("clouds_all"),
        (by_band(1) + F.floor(v / 10) * F.when(v < 80, F.lit(1)).otherwise(F.lit(0))).cast("double").alias("weather_id"),
        by_band(0).alias("weather_main"), by_band(2).alias("weather_description"), by_band(3).alias("weather_icon"))
    per_key = ev.groupBy(key.alias("time")).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum("value").alias("_s"))
    measures = []
    for i, name in enumerate(ENERGY_MEASURES):
        m = F.col("_s") * F.lit((i + 1) / 10.0) + F.col("_n") * F.lit(float(i))
        if name == "generation solar":
            m = F.when(F.col("_n") > 1, m)
        measures.append(m.alias(name))
    energy = per_key.select("time", *measures)
    return energy, weather
