"""Evaluation time, calendar distances and ISO text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

Instant = str | dt.datetime | dt.date | Column | None


def instant(as_of: Instant, data_type: T.DataType | str = "timestamp") -> Column:
    """`as_of` as a column of `data_type`; the current time if it is None.

    It takes the type of the column it is compared with, so that a filter
    compares column and literal directly and reaches the file scan.
    """
    if as_of is None:
        return F.current_timestamp().cast(data_type)
    if isinstance(as_of, Column):
        return as_of.cast(data_type)
    if isinstance(as_of, dt.datetime) and as_of.tzinfo is not None:
        as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(str(as_of)).cast(data_type)


def instant_like(df: DataFrame, column: str, as_of: Instant) -> Column:
    return instant(as_of, df.schema[column].dataType)


def interval(amount: int | float, unit: str) -> Column:
    """A day-time interval literal, e.g. `interval(30, "day")`."""
    seconds = amount * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit]
    return F.expr(f"INTERVAL '{seconds:f}' SECOND")


def epoch_micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, as an epoch difference (not calendar boundaries)."""
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(86_400e6)


def elapsed_ms(start: Column, end: Column) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1000.0)


def iso_utc(moment: Column) -> Column:
    """`2024-01-01T00:00:07.179575Z`; the session time zone must be UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_iso(text: Column) -> Column:
    """ISO text with `Z`, an offset or none; NULL where it does not parse."""
    return F.try_to_timestamp(text)
