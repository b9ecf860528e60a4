"""Casts that give NULL for bad text, whatever the session's ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_whole(column: Column | str, data_type: str) -> Column:
    """Text to an integer type. Accepts `111.0`, which exports of nullable
    integer columns contain, and truncates as a plain cast does."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(text.try_cast(data_type), text.try_cast("double").try_cast(data_type))


def to_time(column: Column | str) -> Column:
    text = F.col(column) if isinstance(column, str) else column
    return text.try_cast("timestamp")


def seconds_between(earlier: Column, later: Column) -> Column:
    """Fractional seconds, exact to the microsecond."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)
