"""Time as column expressions; "now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_between(a: Column, b: Column) -> Column:
    """Absolute hours."""
    return F.abs(age_hours(a, b))


def age_hours(then: Column, now: Column) -> Column:
    """Signed hours from ``then`` to ``now``."""
    return (F.unix_micros(now) - F.unix_micros(then)) / 3.6e9


def floor_to(at: Column, minutes: int) -> Column:
    """Start of the time bucket, counted from 1970-01-01 UTC."""
    width = minutes * 60_000_000
    us = F.unix_micros(at)
    return F.timestamp_micros(us - F.pmod(us, F.lit(width)))


def parse_date(text: Column) -> Column:
    """Epoch seconds (below 1e12) or milliseconds, 14 or 8 digits in UTC, or ISO; null otherwise."""
    t = F.trim(text)
    number = t.try_cast("double")
    digits = t.rlike(r"^\d+$")
    instant = F.when(number < 1e12, number * 1e6).otherwise(number * 1e3)
    return (
        F.when(digits & (F.length(t) == 14), F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")))
        .when(digits & (F.length(t) == 8), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
        .when(number.isNotNull(), F.timestamp_micros(instant.cast("bigint")))
        .otherwise(t.try_cast("timestamp"))
    )


def relative(then: Column, now: Column, suffix: str = " ago", missing: str | None = None) -> Column:
    """now, 5m, 3h, 2d or 4mo, with ``suffix``; ``missing`` for null."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 6e7)
    some = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit + suffix))
    return (
        F.when(minutes.isNull(), F.lit(missing))
        .when(minutes < 1, "now")
        .when(minutes < 60, some(minutes, "m"))
        .when(minutes < 1440, some(minutes / 60, "h"))
        .when(minutes < 43_200, some(minutes / 1440, "d"))
        .otherwise(some(minutes / 43_200, "mo"))
    )
