"""ISO date parsing and ages. The current time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_TIME = r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_EITHER = r"^(\d{4})-?(\d{2})-?(\d{2})" + _TIME
# the separators must be all there or all missing
_FORMS = r"^\d{4}(?:-\d{2}-\d{2}|\d{4})(?:\D|$)"
_WEEK = r"^(\d{4})-?W(\d{2})(?:-?(\d))?$"


def _group(s: str, pattern: str, i: int) -> str:
    return f"nullif(regexp_extract({s}, r'{pattern}', {i}), '')"


def _calendar(s: str) -> str:
    y, mo, d, h, mi, se, frac, zone = [_group(s, _EITHER, i) for i in range(1, 9)]
    whole = [f"try_cast({x} AS INT)" for x in (y, mo, d)]
    clock = [f"coalesce(try_cast({x} AS INT), 0)" for x in (h, mi)]
    sec = f"CAST(concat(coalesce({se}, '0'), '.', coalesce({frac}, '0')) AS DECIMAL(16, 6))"
    tz = (f"CASE WHEN coalesce({zone}, 'Z') = 'Z' THEN 'UTC' ELSE concat(substr({zone}, 1, 3), ':', "
          f"right({zone}, 2)) END")
    made = f"try_make_timestamp({', '.join([*whole, *clock, sec, tz])})"
    return f"CASE WHEN {s} RLIKE r'{_FORMS}' AND {s} RLIKE r'{_EITHER}' THEN {made} END"


def _week(s: str) -> str:
    y, w, d = [f"try_cast({_group(s, _WEEK, i)} AS INT)" for i in (1, 2, 3)]
    monday = f"CAST(date_trunc('week', try_make_timestamp({y}, 1, 4, 0, 0, CAST(0 AS DECIMAL(16, 6)))) AS DATE)"
    day = f"date_add({monday}, ({w} - 1) * 7 + coalesce({d}, 1) - 1)"
    # a 53rd week must still lie in the ISO year it names
    ok = (f"{s} RLIKE r'{_WEEK}' AND {w} BETWEEN 1 AND 53 AND coalesce({d}, 1) BETWEEN 1 AND 7 "
          f"AND extract(YEAROFWEEK FROM {day}) = {y}")
    return f"CASE WHEN {ok} THEN CAST({day} AS TIMESTAMP) END"


def parse_iso(s: str) -> str:
    """SQL: ISO 8601 date or date-time as timestamp; naive values are UTC; else NULL."""
    return f"coalesce({_calendar(s)}, {_week(s)})"


def age_days(ts: str, as_of: str) -> str:
    """SQL: days from a timestamp to the evaluation time; future dates count as 0."""
    now = f"unix_micros(CAST('{as_of}' AS TIMESTAMP))"
    days = f"({now} - unix_micros(CAST({ts} AS TIMESTAMP))) / 86400e6D"
    # `greatest` skips NULLs, so a missing time must be kept apart
    return f"CASE WHEN {ts} IS NOT NULL THEN greatest(0.0D, {days}) END"


def decay(days: str, half_life_days: float) -> str:
    """SQL: exp(-age / scale); the parameter is an e-folding time despite its name."""
    return f"exp(-({days}) / {float(max(1.0, half_life_days))!r}D)"


def hours_between(start: Column, end: Column) -> Column:
    a, b = [F.unix_micros(c.cast("timestamp")) for c in (start, end)]
    return (b - a) / F.lit(3.6e9)
