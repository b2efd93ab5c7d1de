"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Strftime directive -> (Java letters when digits follow directly, letters otherwise).
# A single letter accepts numbers with or without a leading zero, as strptime does.
_DIRECTIVES = {
    "Y": ("yyyy", "yyyy"),
    "y": ("yy", "yy"),
    "m": ("MM", "M"),
    "d": ("dd", "d"),
    "H": ("HH", "H"),
    "I": ("hh", "h"),
    "M": ("mm", "m"),
    "S": ("ss", "s"),
    "f": ("SSSSSS", "SSSSSS"),
    "p": ("a", "a"),
    "b": ("MMM", "MMM"),
    "B": ("MMMM", "MMMM"),
    "j": ("DDD", "D"),
}


def java_pattern(strftime_mask: str) -> str:
    """Translate a strftime mask to the pattern Spark parses with."""
    out: list[str] = []
    literal = ""
    tokens: list[tuple[bool, str]] = []
    i = 0
    while i < len(strftime_mask):
        ch = strftime_mask[i]
        if ch == "%" and i + 1 < len(strftime_mask) and strftime_mask[i + 1] != "%":
            tokens.append((True, strftime_mask[i + 1]))
            i += 2
        else:
            i += 2 if ch == "%" else 1
            tokens.append((False, ch))
    for pos, (is_directive, value) in enumerate(tokens):
        if not is_directive:
            literal += value
            continue
        if value not in _DIRECTIVES:
            raise ValueError(f"date mask directive %{value} is not supported")
        out.append(_quote(literal))
        literal = ""
        before = pos > 0 and tokens[pos - 1][0]
        after = pos + 1 < len(tokens) and tokens[pos + 1][0]
        out.append(_DIRECTIVES[value][0 if before or after else 1])
    out.append(_quote(literal))
    return "".join(out)


def _quote(literal: str) -> str:
    if any(ch.isalpha() for ch in literal):
        return "'" + literal.replace("'", "''") + "'"
    return literal.replace("'", "''")


def epoch_millis_to_date(c: Column) -> Column:
    """UTC date of an epoch in milliseconds; 0 and NULL give NULL."""
    millis = F.nullif(c.cast("bigint"), F.lit(0))
    return F.date_from_unix_date(F.floor(millis / F.lit(86_400_000)).cast("int"))


def iso_year(c: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), c).cast("int")


def iso_week(c: Column) -> Column:
    return F.weekofyear(c).cast("int")


def look_back(end: Column, weeks: int = 4) -> dict[str, Column]:
    """ISO year and week at the end of a capture window, and ``weeks`` weeks before it."""
    start = F.date_sub(end.cast("date"), 7 * weeks)
    return {"year_end": iso_year(end), "week_end": iso_week(end), "year_start": iso_year(start), "week_start": iso_week(start)}


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with their fraction; NULL when either side is not a timestamp."""
    micros = F.unix_micros(end.try_cast("timestamp")) - F.unix_micros(start.try_cast("timestamp"))
    return micros.cast("double") / F.lit(1_000_000.0)


def bucket_end(c: Column, freq: str) -> Column:
    """Label of the day, Sunday-ended week or month-ended month a date falls in."""
    day = c.cast("date")
    if freq == "D":
        return day
    if freq == "W":
        return F.next_day(F.date_sub(day, 1), "SUN")
    if freq == "M":
        return F.last_day(day)
    raise ValueError(f"frequency {freq!r} is not D, W or M")
