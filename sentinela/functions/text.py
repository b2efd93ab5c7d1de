"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Invisible and wide blank characters removed before two systems are compared.
INVISIBLE_CHARACTERS = "[\\u200B\\u00A0\\u2000-\\u200F\\u2028\\u2029\\u3000\\uFEFF\\u200C\\u200D]"


def strip_invisible(c: Column) -> Column:
    """Trim, drop invisible characters, trim again what they were hiding."""
    return F.trim(F.regexp_replace(F.trim(c), INVISIBLE_CHARACTERS, ""))


def slice_text(c: Column, start: int, end: int) -> Column:
    """Characters ``start`` (0-based) up to, not including, ``end``."""
    return F.substring(c, start + 1, max(end - start, 0))


def strip_parenthesis_suffix(c: Column) -> Column:
    """``Name (XX)`` -> ``Name``; the last `` (`` counts, text without one is kept."""
    return F.regexp_replace(c, r"(?s)^(.*) \(.*$", "$1")


def contains_term(c: Column, term: str, regex: bool = False) -> Column:
    """Case-insensitive search; a NULL text never matches."""
    match = c.rlike("(?i)" + term) if regex else F.contains(F.lower(c), F.lit(term.lower()))
    return F.coalesce(match, F.lit(False))
