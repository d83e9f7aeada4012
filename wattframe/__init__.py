"""wattframe — Spark-native operators for hourly, multi-entity time-series tables.

Worked out on national energy generation / load / price joined with city weather, but every
operator is parametrised by key, entity and measure columns, so the same code serves any
long (time, entity, measures...) table.  Every operator takes DataFrames and returns DataFrames;
the work is declared with the DataFrame / SQL / ML APIs and executed by Spark.
"""

from wattframe.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
__version__ = "0.1.0"
