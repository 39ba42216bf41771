"""Time expressions. Everything is UTC; zones are applied only for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_millis(c: str | Column) -> Column:
    """Epoch milliseconds to timestamp, floored to the second."""
    return F.timestamp_seconds(F.floor(_c(c) / F.lit(1000)))


def from_seconds(c: str | Column) -> Column:
    return F.timestamp_seconds(_c(c))


def slot(ts: str | Column, step: int = 3600) -> Column:
    """Number of whole steps since the epoch (floor, also before 1970)."""
    return F.floor(F.unix_seconds(_c(ts)) / F.lit(step)).cast("long")


def slot_start(s: str | Column, step: int = 3600) -> Column:
    return F.timestamp_seconds(_c(s) * F.lit(step))


def floor_to(ts: str | Column, seconds: int) -> Column:
    return slot_start(slot(ts, seconds), seconds)


def floor_hour(ts: str | Column) -> Column:
    return F.date_trunc("hour", _c(ts))


def floor_day(ts: str | Column) -> Column:
    return F.date_trunc("day", _c(ts))


def week_ending_sunday(ts: str | Column) -> Column:
    """Label of the Monday-to-Sunday week: its Sunday."""
    return F.date_trunc("week", _c(ts)) + F.expr("INTERVAL 6 DAYS")


def round_hour(ts: str | Column) -> Column:
    """Nearest hour; exactly half past goes to the even hour."""
    micros = F.unix_micros(_c(ts))
    hour = F.floor(micros / F.lit(3_600_000_000)).cast("long")
    rest = micros - hour * F.lit(3_600_000_000)
    half = F.lit(1_800_000_000)
    up = (rest > half) | ((rest == half) & (F.pmod(hour, F.lit(2)) == 1))
    return F.timestamp_seconds((hour + up.cast("long")) * F.lit(3600))


def parse_lenient(c: str | Column, fmt: str | None = None) -> Column:
    """Timestamp or null when the text does not parse."""
    return F.try_to_timestamp(_c(c), F.lit(fmt)) if fmt else F.try_to_timestamp(_c(c))


def stamp_from_name(name: str | Column) -> Column:
    """Fetch time in a file name suffix: 14 digits carry seconds, 12 digits minutes."""
    digits = F.regexp_extract(_c(name), r"_(\d{12,14})\.[A-Za-z]+$", 1)
    return (F.when(F.length(digits) == 14, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))
            .when(F.length(digits) == 12, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmm"))))


def to_zone(ts: str | Column, tz: str = "US/Eastern") -> Column:
    return F.from_utc_timestamp(_c(ts), tz)


def hours_between(later: str | Column, earlier: str | Column) -> Column:
    """Difference in fractional hours."""
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / F.lit(3.6e9)


def stamp_text(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")
