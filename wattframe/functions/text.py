"""String functions: regex replace + trim, repair chains, token cleaning, icon suffixes.

All are built-in ``regexp_replace`` / ``trim`` / ``concat`` expressions, null-safe (a null input gives
null, never an error) and applied to the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattframe.schemas import DAY_NIGHT_ICONS, DESCRIPTION_RULES


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_META = set("\\.^$|?*+()[]{}")


def escape_literal(text: str) -> str:
    """Escape regex metacharacters only (blanks stay blanks), portable across regex dialects."""
    return "".join("\\" + ch if ch in _META else ch for ch in text)


def replace_trim(col, pattern: str, replacement: str, literal: bool = True) -> Column:
    """Replace every match of ``pattern`` and trim the result (null stays null)."""
    pat = escape_literal(pattern) if literal else pattern
    rep = replacement.replace("\\", "\\\\").replace("$", "\\$") if literal else replacement
    return F.trim(F.regexp_replace(_c(col), F.lit(pat), F.lit(rep)))


BLANKS = r"[ \t\n\x0B\f\r]+"


def collapse_blanks(col) -> Column:
    """Runs of whitespace become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(_c(col), BLANKS, " "))


def repair_text(col, rules=DESCRIPTION_RULES, collapse: bool = True) -> Column:
    """Apply ``(pattern, replacement)`` rules in order, each followed by trim.

    ``collapse=True`` also collapses inner whitespace after each step so a rule that inserts a
    leading blank cannot leave a double blank that the next literal rule fails to match.
    ``collapse=False`` reproduces the plain replace-then-trim chain.
    """
    out = _c(col)
    for pat, rep in rules:
        out = replace_trim(out, pat, rep)
        if collapse:
            out = collapse_blanks(out)
    return out


def clean_token(col) -> Column:
    """Value made safe for use in a column name: blanks and brackets removed."""
    return F.regexp_replace(_c(col), r"[\s\[\]]", "")


def day_night_icon(col, known=DAY_NIGHT_ICONS) -> Column:
    """Icons without a day/night suffix get ``d`` appended; known ones pass unchanged."""
    c = _c(col)
    return F.when(c.isin(list(known)), c).otherwise(F.trim(F.concat(c, F.lit("d"))))


def normalised_equals(col, value: str) -> Column:
    """``lower(trim(col)) = value`` — case/blank-insensitive equality on a text key."""
    return F.lower(F.trim(_c(col))) == F.lit(value.strip().lower())
