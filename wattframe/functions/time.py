"""Time functions: offset-text parsing, hour keys, calendar parts, year ranges.

Calendar parts are taken on the UTC wall clock (the session zone is UTC), so a local
``2018-01-01 00:00:00+01:00`` is hour 23 of 2017-12-31.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_PATTERN = "yyyy-MM-dd HH:mm:ssXXX"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_offset_timestamp(col, pattern: str = OFFSET_PATTERN, ntz: bool = True) -> Column:
    """Text with a UTC offset (``2018-03-14 10:00:00+01:00``) → the UTC instant.

    ``ntz=True`` returns it as ``timestamp_ntz`` holding the UTC wall clock (stable whatever the
    reader's zone); otherwise a session-zone ``timestamp``.
    """
    ts = F.to_timestamp(_c(col), pattern)
    return F.to_timestamp_ntz(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")) if ntz else ts


def hour_key(col, unit: str = "hour") -> Column:
    """Truncate a ``timestamp_ntz`` wall clock to ``unit`` (``day``/``hour``/``minute``), zone-free.

    Built from the wall-clock fields, so the result does not depend on the session time zone (a
    round trip through a zoned timestamp would shift times that fall in a DST gap).
    """
    c = _c(col)
    parts = {"day": (F.lit(0), F.lit(0)), "hour": (F.lit(0), F.lit(0)), "minute": (F.minute(c), F.lit(0))}
    if unit not in parts:
        return F.date_trunc(unit, c).cast("timestamp_ntz")
    mi, se = parts[unit]
    hr = F.lit(0) if unit == "day" else F.hour(c)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), hr, mi, se)


def calendar_parts(col, as_double: bool = True) -> dict[str, Column]:
    """hour, weekday (Monday = 0), month, year of a timestamp — as doubles for parity."""
    c = _c(col)
    parts = {"hour": F.hour(c), "weekday": F.weekday(c), "month": F.month(c), "year": F.year(c)}
    if as_double:
        parts = {k: v.cast("double") for k, v in parts.items()}
    return parts


def year_range(col, year: int) -> Column:
    """``year(col) = year`` written as a half-open range so it reaches the scan as a pushed filter."""
    c = _c(col)
    lo, hi = _dt.datetime(year, 1, 1), _dt.datetime(year + 1, 1, 1)
    return (c >= F.lit(lo).cast("timestamp_ntz")) & (c < F.lit(hi).cast("timestamp_ntz"))
