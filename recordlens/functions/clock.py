"""Column expressions over ISO time strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_seconds(value: Column) -> Column:
    """Seconds since the epoch; a missing offset means UTC, unreadable text is null."""
    has_offset = value.rlike(r"T.*([+-]\d{2}:?\d{2}|Z)$")
    with_zone = F.when(has_offset, value).otherwise(
        F.when(F.length(value) > 10, F.concat(value, F.lit("Z"))).otherwise(
            F.concat(value, F.lit("T00:00:00Z"))
        )
    )
    return F.try_to_timestamp(with_zone).cast("double")


def text_before(a: Column, b: Column) -> Column:
    """Compare two ISO strings on their first 19 characters, as text."""
    return F.substring(a, 1, 19) < F.substring(b, 1, 19)


def before(a: Column, b: Column, time_mode: str = "parsed") -> Column:
    """``a < b`` by parsed instant, or as text when ``time_mode='text'``."""
    return text_before(a, b) if time_mode == "text" else iso_seconds(a) < iso_seconds(b)


def day_of(value: Column) -> Column:
    return F.substring(value, 1, 10)


def day_diff(later: Column, earlier: Column) -> Column:
    return F.datediff(F.to_date(day_of(later)), F.to_date(day_of(earlier)))


def verbatim_date(value: Column) -> Column:
    """A date string of at least ten characters as it stands, else null."""
    return F.when(F.length(value) >= 10, value)


def span_words(start: Column, end: Column) -> Column:
    """Distance between two ISO times in words: hours, from 48 on days."""
    hours = F.greatest(F.lit(1), F.bround((iso_seconds(end) - iso_seconds(start)) / 3600).cast("long"))
    days = F.bround(hours / 24).cast("long")
    return (
        F.when(hours >= 48, F.concat(days.cast("string"), F.lit(" days")))
        .when(hours == 1, F.lit("1 hour"))
        .otherwise(F.concat(hours.cast("string"), F.lit(" hours")))
    )
