"""Clock strings such as ``01h:02m:03s:004ms`` and their numeric forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK_PATTERN = r"^\s*(\d+)h:(\d+)m:(\d+)s:(\d+)ms"


def whole_div(a: Column, b: Column | int) -> Column:
    """Integer division that stays BIGINT."""
    return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint"))


def _digits(number: Column, width: int) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def ms_to_clock(ms: Column) -> Column:
    """Milliseconds to ``HHh:MMm:SSs:mmmms``; the hour keeps growing past 99.

    Built by padding: a format string costs several times as much per row.
    """
    total = ms.cast("bigint")
    return F.concat(
        _digits(whole_div(total, 3_600_000), 2),
        F.lit("h:"),
        _digits(whole_div(total, 60_000) % 60, 2),
        F.lit("m:"),
        _digits(whole_div(total, 1000) % 60, 2),
        F.lit("s:"),
        _digits(total % 1000, 3),
        F.lit("ms"),
    )


def _part(text: Column, group: int) -> Column:
    return F.regexp_extract(text, CLOCK_PATTERN, group).try_cast("bigint")


def clock_to_ms(text: Column) -> Column:
    """Clock string to milliseconds, null when the text is no clock string."""
    return (
        _part(text, 1) * 3_600_000
        + _part(text, 2) * 60_000
        + _part(text, 3) * 1000
        + _part(text, 4)
    )


def clock_to_seconds(text: Column) -> Column:
    """Clock string or plain number of seconds to seconds; blank or bad text gives 0."""
    return F.coalesce(
        clock_to_ms(text) / F.lit(1000.0), F.trim(text).try_cast("double"), F.lit(0.0)
    )


def colon_time_to_ms(text: Column) -> Column:
    """``HH:MM:SS``, ``MM:SS`` or plain seconds to milliseconds; anything else gives 0."""
    parts = F.split(text, ":")
    last = F.try_element_at(parts, F.lit(-1)).try_cast("double")
    first = F.try_element_at(parts, F.lit(1)).try_cast("bigint")
    second = F.try_element_at(parts, F.lit(2)).try_cast("bigint")
    seconds = (
        F.when(F.size(parts) == 3, first * 3600 + second * 60 + last)
        .when(F.size(parts) == 2, first * 60 + last)
        .when(F.size(parts) == 1, last)
    )
    return F.coalesce((seconds * 1000).try_cast("bigint"), F.lit(0).cast("bigint"))


def seconds_to_display(seconds: Column) -> Column:
    """``1h 2m 3s`` with leading zero units left out."""
    total = F.floor(seconds)
    h, m, s = whole_div(total, 3600), whole_div(total, 60) % 60, total % 60
    hours, minutes = (
        F.concat(unit.cast("string"), F.lit(f"{name} ")) for unit, name in ((h, "h"), (m, "m"))
    )
    rest = F.concat(s.cast("string"), F.lit("s"))
    return (
        F.when(h > 0, F.concat(hours, minutes, rest))
        .when(m > 0, F.concat(minutes, rest))
        .otherwise(rest)
    )


def iso_to_timestamp(text: Column) -> Column:
    """ISO date-time, a trailing ``Z`` meaning UTC; null when it does not parse."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
