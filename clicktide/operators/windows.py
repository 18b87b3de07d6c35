"""The windowed aggregate, one definition for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Window width and relative error of the distinct count.
WINDOW_WIDTH = "10 seconds"
USERS_RSD = 0.05
# Sketches of 2^12 registers: a standard error of 1.6 %.
SKETCH_LG_K = 12


def campaign_windows(
    events: DataFrame, width: str = WINDOW_WIDTH, users: str = "approx", rsd: float = USERS_RSD
) -> DataFrame:
    """Events and users per tumbling window and campaign, in the shape of ``campaign_agg``.

    Every event counts, whatever its ``clicked`` flag. ``users="exact"`` is for batch only. Both
    forms combine before the shuffle; the exact one first shuffles on (window, campaign, user), so a
    campaign with a third of all events is spread over its users.
    """
    if users == "approx":
        unique = F.approx_count_distinct("user_id", rsd)
    elif users == "exact":
        unique = F.count_distinct("user_id")
    else:
        raise ValueError(f"users must be 'approx' or 'exact', not {users!r}")
    grouped = events.groupBy(F.window("event_time", width), "campaign_id").agg(
        F.count(F.lit(1)).alias("clicks"), unique.alias("unique_users")
    )
    return grouped.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "campaign_id",
        "clicks",
        "unique_users",
        F.lit(None).cast("double").alias("ctr"),
    )


def user_sketches(events: DataFrame, width: str = WINDOW_WIDTH) -> DataFrame:
    """A mergeable sketch of the users per window and campaign, to be kept beside the counts.

    Sums of ``unique_users`` count a user once per window; unions of sketches count it once.
    """
    grouped = events.groupBy(F.window("event_time", width), "campaign_id").agg(
        F.hll_sketch_agg("user_id", SKETCH_LG_K).alias("users")
    )
    return grouped.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "campaign_id",
        "users",
    )


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """One sketch per key, of all users of its windows; may be kept and merged again."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("users").alias("users"))


def users_of(sketches: DataFrame) -> DataFrame:
    """Sketches replaced by the numbers of users they stand for."""
    return sketches.withColumn("users", F.hll_sketch_estimate("users"))


def latest_window_end(events: DataFrame, width: str = WINDOW_WIDTH) -> DataFrame:
    """One row: the end of the newest window, straight from the events (reads only their times)."""
    newest = events.agg(F.max("event_time").alias("event_time"))
    return newest.select(F.window("event_time", width)["end"].alias("window_end"))
