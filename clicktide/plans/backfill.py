"""Recomputing the most recent windows from stored events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.contracts import AGG_KEYS, AGG_VALUES, conform
from clicktide.functions.times import first_start, micros
from clicktide.operators.grid import fill_grid, window_grid
from clicktide.operators.table import CampaignTable
from clicktide.operators.windows import WINDOW_WIDTH
from clicktide.plans.serving import recent_windows
from clicktide.session import materialize
from clicktide.sources.settings import DEFAULT_BACKFILL_WINDOWS


def backfill(
    events: DataFrame,
    campaigns: DataFrame | None = None,
    windows: int = DEFAULT_BACKFILL_WINDOWS,
    width: str = WINDOW_WIDTH,
    as_of: datetime | Column | DataFrame | None = None,
    **how: object,
) -> DataFrame:
    """A row for each of the last ``windows`` windows and each campaign, zero where none happened.

    ``campaigns`` is a frame with ``campaign_id``, such as the aggregate table; without it the names
    are those of the events in the windows, and no others are read.
    """
    span = backfill_span(windows, width)
    if campaigns is None:
        start = first_start(as_of, span, width, events.schema["event_time"].dataType)
        campaigns = events.where(F.col("event_time") >= start)
    grid = window_grid(campaigns, windows, width, as_of)
    return fill_grid(grid, recent_windows(events, width, span, as_of, **how))


def backfill_span(windows: int, width: str) -> str:
    """The time that the windows cover together."""
    return f"{micros(width) * windows // 10**6} seconds"


def differences(recomputed: DataFrame, stored: DataFrame) -> DataFrame:
    """``recomputed`` with a column ``state``: inserted, changed or same, against the stored rows.

    Values are compared by a hash that tells null from zero. Both sides have each key once.
    """
    values = F.xxhash64(*[F.struct(F.col(name).isNull(), name) for name in AGG_VALUES])
    was = stored.select(*AGG_KEYS, values.alias("__was"))
    joined = recomputed.join(was, list(AGG_KEYS), "left")
    state = (
        F.when(F.col("__was").isNull(), "inserted")
        .when(F.col("__was") == values, "same")
        .otherwise("changed")
    )
    return joined.select(*AGG_KEYS, *AGG_VALUES, state.alias("state"))


def reconcile(table: CampaignTable, recomputed: DataFrame, since: object = None) -> DataFrame:
    """Write the recomputed rows that differ from the table, and no others; returns ``differences``.

    Where nothing differs there is no write. ``since``, a day or a time, bounds what is read of the
    table: the recomputed windows must end on that day or later.
    """
    spark = recomputed.sparkSession
    found = materialize(differences(conform(recomputed), table.latest(spark, since)), "differences")
    news = found.where("state <> 'same'")
    if not news.isEmpty():
        table.upsert(news.drop("state"))
    return found
