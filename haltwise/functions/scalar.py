"""Column helpers: identifiers, time, ranges, angles, arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/Helsinki"


def append_unique(array: Column, item: Column) -> Column:
    """The array with the item once at its end; a null array counts as empty."""
    have = F.coalesce(array, F.array().cast("array<string>"))
    return F.when(F.array_contains(have, item), have).otherwise(F.array_append(have, item))


def seconds_between(start: Column, end: Column) -> Column:
    """Exact seconds with fractions between two timestamps."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def add_seconds(time: Column, seconds: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.round(seconds * 1e6).cast("long"), time)


def epoch_us(time: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), time)


def local_time(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    """A UTC wall-clock timestamp in local time; does not depend on the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def journey_id(route: Column, direction: Column, start_utc: Column, oper: Column, veh: Column) -> Column:
    """32 hex digits that identify a journey by its route, direction, local start, operator and vehicle."""
    local = local_time(start_utc)
    return F.md5(F.concat_ws("_", route, direction, F.date_format(local, "yyyy-MM-dd"), F.date_format(local, "HH:mm:ss"), oper, veh))


def linear_interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """y at x on the line through two points; null where they have the same x."""
    return y0 + (x - x0) * F.try_divide(y1 - y0, x1 - x0)


def range_length(low: Column, high: Column) -> Column:
    return high - low


def minimum_angle(a: Column, b: Column, strict: bool = False) -> Column:
    """Difference of two bearings in degrees; null if either is.

    Differences over 180 give the difference less 180, as existing results have
    it; strict gives the smaller angle, 360 less the difference.
    """
    d = F.abs(a - b)
    return F.when(d > 180, (F.lit(360) - d) if strict else (d - 180)).otherwise(d)


def halt_code(first: Column, second: Column) -> Column:
    """0 for neither, 1 for the first, 2 for the second, 3 for both."""
    return first.cast("int") + 2 * second.cast("int")


def to_smallint(c: Column) -> Column:
    """The value if it fits into 16 bits, else null."""
    return F.when(c.between(-32768, 32767), c.cast("short"))


def parse_clock(c: Column) -> Column:
    """Seconds of HH:MM:SS, where HH may be 24 or more."""
    p = F.split(c, ":")
    return F.get(p, 0).cast("long") * 3600 + F.get(p, 1).cast("long") * 60 + F.get(p, 2).cast("long")


def kmh(metres: Column, seconds: Column) -> Column:
    return 3.6 * F.try_divide(metres, seconds)
