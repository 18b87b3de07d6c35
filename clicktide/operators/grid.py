"""A row for every recent window and campaign, also where nothing happened."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.contracts import AGG_KEYS
from clicktide.functions.times import duration, floor_point, moment
from clicktide.operators.windows import WINDOW_WIDTH


def window_grid(
    campaigns: DataFrame,
    windows: int,
    width: str = WINDOW_WIDTH,
    as_of: datetime | Column | DataFrame | None = None,
) -> DataFrame:
    """The last ``windows`` complete windows before ``as_of`` for each distinct campaign.

    Each campaign row makes its own windows, so there is no join and no shuffle beyond the distinct.
    """
    if windows < 1:
        raise ValueError("windows must be at least 1")
    steps = F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("step")
    names = campaigns.select("campaign_id").where(F.col("campaign_id").isNotNull()).distinct()
    grid = names.select("campaign_id", moment(as_of).alias("as_of"), steps)
    end = floor_point(F.col("as_of"), width) - duration(width) * F.col("step")
    return grid.select("campaign_id", end.alias("window_end")).select(
        (F.col("window_end") - duration(width)).alias("window_start"), "window_end", "campaign_id"
    )


def fill_grid(grid: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Grid rows with the aggregates found for them; zero where there are none.

    Both sides have at most one row per key, so no key can be hot. Spark broadcasts the aggregates
    only when it knows them to be small, and otherwise shuffles both sides on the whole key.
    """
    found = grid.join(aggregates, list(AGG_KEYS), "left")
    counts = [
        F.greatest(F.lit(0).cast("long"), F.coalesce(F.col(name), F.lit(0))).alias(name)
        for name in ("clicks", "unique_users")
    ]
    return found.select(*AGG_KEYS, *counts, "ctr")
