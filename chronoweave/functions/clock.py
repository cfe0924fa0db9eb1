"""Durations in whole minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column. A column without a zone counts as it reads, whatever the session's zone:
    an hour that the zone skips is as long as any other."""
    if isinstance(df.schema[name].dataType, (T.TimestampNTZType, T.DateType)):
        quoted = name.replace("`", "``")
        return F.expr(f"(cast(`{quoted}` as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00') div interval '0.000001' second")
    return F.unix_micros(F.col(name).cast("timestamp"))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Whole minutes from `start` to `end`, cut toward zero."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MINUTE", start, end)


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Whole minutes from `start` to `end`, as hours."""
    return minutes_between(start, end) / F.lit(60.0)
