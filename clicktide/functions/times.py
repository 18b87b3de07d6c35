"""Intervals, window alignment and points in time."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

_UNIT_MICROS = {
    "millisecond": 10**3,
    "second": 10**6,
    "minute": 60 * 10**6,
    "hour": 3600 * 10**6,
    "day": 86400 * 10**6,
}
_PART = r"(\d+) (millisecond|second|minute|hour|day)s?"


def micros(text: str) -> int:
    """Length of a duration such as ``10 seconds`` or ``1 hour 30 minutes``."""
    if not re.fullmatch(rf"{_PART}( {_PART})*", text):
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(count) * _UNIT_MICROS[unit] for count, unit in re.findall(_PART, text))


def duration(text: str) -> Column:
    """The duration as an interval column."""
    micros(text)
    return F.expr(f"interval {text}")


def moment(as_of: datetime | Column | DataFrame | None) -> Column:
    """A point in time: a literal (UTC if it names no zone), a column, the only value of a one-row
    frame, or now.
    """
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, DataFrame):
        return as_of.scalar()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc))


def moment_before(as_of: datetime | Column | DataFrame | None, ago: str) -> Column:
    """The point in time ``ago`` earlier.

    For a frame the difference is taken inside the subquery, which leaves a bare value that Spark
    can push to the Parquet reader.
    """
    if isinstance(as_of, DataFrame):
        (name,) = as_of.columns
        return as_of.select((F.col(name) - duration(ago)).alias(name)).scalar()
    return moment(as_of) - duration(ago)


def floor_point(point: Column, width: str) -> Column:
    """One point in time floored to the window boundary; folds to a literal when the point does."""
    since_epoch = F.unix_micros(point.cast("timestamp"))
    return F.timestamp_micros(since_epoch - F.pmod(since_epoch, F.lit(micros(width))))


def align_to_window(df: DataFrame, column: str, width: str = "10 seconds") -> DataFrame:
    """Add ``window_start``, the time floored to the window boundary."""
    return df.withColumn("window_start", F.window(column, width)["start"])


def first_start(
    as_of: datetime | Column | DataFrame | None, ago: str, width: str, kind: DataType
) -> Column:
    """Start of the oldest window that ends later than ``ago`` before ``as_of``.

    A window ends after a point exactly when it holds the point or starts after it, so this is the
    point floored. Comparing raw event times with it is the same as comparing window ends with the
    point, and reaches the scan.
    """
    if isinstance(as_of, DataFrame):
        (name,) = as_of.columns
        start = floor_point(F.col(name) - duration(ago), width)
        return as_of.select(start.cast(kind).alias(name)).scalar()
    return floor_point(moment(as_of) - duration(ago), width).cast(kind)
