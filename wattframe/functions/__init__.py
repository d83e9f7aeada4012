"""Column-level building blocks: every function returns a ``Column`` (JVM-side, codegen-able)."""

from wattframe.functions.columns import (columns_of_type, entity_suffix, null_propagating_sum, normalise_columns,
                                         rename_all)
from wattframe.functions.hashing import hash_fraction_below, hash_fold, stable_order_key
from wattframe.functions.text import (clean_token, day_night_icon, repair_text, replace_trim,
                                      collapse_blanks)
from wattframe.functions.time import (calendar_parts, hour_key, parse_offset_timestamp, year_range)

__all__ = [
    "columns_of_type", "entity_suffix", "null_propagating_sum", "normalise_columns", "rename_all",
    "hash_fraction_below", "hash_fold", "stable_order_key",
    "clean_token", "day_night_icon", "repair_text", "replace_trim", "collapse_blanks",
    "calendar_parts", "hour_key", "parse_offset_timestamp", "year_range",
]
