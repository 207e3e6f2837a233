"""Times as columns, the same for timestamps with and without a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(time: Column) -> Column:
    """Microseconds since 1970 of the wall-clock time."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), time.cast("timestamp_ntz"))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds, at least 0."""
    return F.greatest(F.lit(0), F.floor((micros(end) - micros(start)) / 1000))


def local_parts(time: Column, zone: str) -> Column:
    """struct(iso, clock, day) of a UTC time in a zone."""
    t = F.convert_timezone(F.lit("UTC"), F.lit(zone), time.cast("timestamp_ntz"))
    return F.struct(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(t, "HH:mm:ss").alias("clock"), F.date_format(t, "EEEE").alias("day"))


def backoff_seconds(attempt: Column, most: int = 300) -> Column:
    return F.least(F.lit(float(most)), F.pow(F.lit(2.0), attempt.cast("double")))
