"""Date and time functions, in UTC sessions; weeks start on Monday."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import guarded

_SECONDS = "decimal(18,6)"


def _century(year: Column) -> Column:
    return F.when(year > 0, F.floor((year + 99) / 100)).otherwise(-F.floor((100 - year - 1) / 100) - 1).cast("int")


def _second(x: Column) -> Column:
    return F.date_part(F.lit("SECOND"), x).cast(_SECONDS)


def _of_day(x: Column) -> Column:
    """Seconds of the epoch, exact to the microsecond."""
    return (F.unix_micros(x.cast("timestamp")).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(20,6)")


_FIELDS = {
    "year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": _second,
    "milliseconds": lambda x: _second(x) * 1000, "microseconds": lambda x: (_second(x) * 1_000_000).cast("bigint"),
    "dow": lambda x: F.dayofweek(x) - 1, "isodow": lambda x: F.weekday(x) + 1, "doy": F.dayofyear, "week": F.weekofyear,
    "quarter": F.quarter, "decade": lambda x: F.floor(F.year(x) / 10).cast("int"), "century": lambda x: _century(F.year(x)),
    "isoyear": lambda x: F.date_part(F.lit("YEAROFWEEK"), x).cast("int"), "epoch": _of_day,
}


def extract(field: str, x: Column) -> Column:
    """EXTRACT(field FROM x) of a date or timestamp, as numeric."""
    if field.lower() not in _FIELDS:
        raise ValueError(f"22023: unit {field!r} is not supported")
    return _FIELDS[field.lower()](x).cast("decimal(26,6)")


def date_part(field: str, x: Column) -> Column:
    return extract(field, x).cast("double")


def date_trunc(unit: str, x: Column) -> Column:
    """Truncated timestamps, also to decade and century; dates become timestamps."""
    stamp = x.cast("timestamp_ntz")
    if unit.lower() in ("decade", "century"):
        step, shift = (10, 0) if unit.lower() == "decade" else (100, 1)
        first = (F.floor((F.year(stamp) - shift) / step) * step + shift).cast("int")
        return F.make_date(first, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    unit = {"milliseconds": "millisecond", "microseconds": "microsecond"}.get(unit.lower(), unit)
    return F.date_trunc(unit, stamp).cast("timestamp_ntz")


def timezone_of_local(zone: Column, local: Column) -> Column:
    """timestamp AT TIME ZONE zone: the moment of a local time."""
    return F.to_utc_timestamp(local.cast("timestamp"), zone).cast("timestamp")


def timezone_of_moment(zone: Column, moment: Column) -> Column:
    """timestamptz AT TIME ZONE zone: the local time of a moment."""
    return F.from_utc_timestamp(moment.cast("timestamp"), zone).cast("timestamp_ntz")


def age(later: Column, earlier: Column | None = None) -> Column:
    """A day-time interval; with one argument, midnight today less it."""
    if earlier is None:
        later, earlier = F.current_date().cast("timestamp_ntz"), later
    return later.cast("timestamp_ntz") - earlier.cast("timestamp_ntz")


def days_between(later: Column, earlier: Column) -> Column:
    """date - date: whole days."""
    return F.datediff(later, earlier)


_PATTERNS = {
    "YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss",
    "Month": "MMMM", "Mon": "MMM", "Day": "EEEE", "Dy": "EEE", "MS": "SSS",
}


def to_char(x: Column, pattern: str) -> Column:
    """Dates and timestamps by a template."""
    token = re.compile("|".join(sorted(_PATTERNS, key=len, reverse=True)))
    out, at = [], 0
    for m in token.finditer(pattern):
        if m.start() > at:
            out.append("'" + pattern[at : m.start()].replace("'", "''") + "'")
        out.append(_PATTERNS[m[0]])
        at = m.end()
    if at < len(pattern):
        out.append("'" + pattern[at:].replace("'", "''") + "'")
    return F.date_format(x, "".join(out))


def to_char_number(x: Column, pattern: str) -> Column:
    """Numbers, rounded to as many places as the template has after its point."""
    places = len(re.sub("[^09]", "", pattern.partition(".")[2]))
    return F.round(x.cast("decimal(38,10)"), places).cast(f"decimal(38,{places})").cast("string")


def make_date(y: Column, m: Column, d: Column) -> Column:
    bad = ~(m.between(1, 12) & d.between(1, 31))
    return guarded(bad, "22008", "date field value out of range", F.make_date(y.cast("int"), m.cast("int"), d.cast("int")))


FUNCTIONS = {
    "now": F.current_timestamp, "current_timestamp": F.current_timestamp, "transaction_timestamp": F.current_timestamp,
    "statement_timestamp": F.current_timestamp, "clock_timestamp": F.current_timestamp, "localtimestamp": F.localtimestamp,
    "current_date": F.current_date, "extract": extract, "date_part": date_part, "date_trunc": date_trunc, "make_date": make_date,
    "timezone": timezone_of_moment, "age": age, "to_char": to_char,
}
