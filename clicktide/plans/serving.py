"""Queries that serve the aggregate table: totals, newest window, trailing slice, KPIs, pivot."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from clicktide.functions.times import first_start, moment_before
from clicktide.operators.rank import global_rank
from clicktide.operators.table import CampaignTable
from clicktide.operators.windows import campaign_windows, latest_window_end

# Horizon choices of the dashboard, in minutes.
HORIZON_MIN, HORIZON_MAX, HORIZON_STEP, HORIZON_DEFAULT = 5, 120, 5, 15

# Windows that ``clicks_by_campaign`` shows at most; two hours have 720.
MAX_SHOWN_WINDOWS = 100_000


def horizon(minutes: int = HORIZON_DEFAULT) -> str:
    """Duration text for a horizon the dashboard offers."""
    if minutes not in range(HORIZON_MIN, HORIZON_MAX + 1, HORIZON_STEP):
        raise ValueError(
            f"minutes must be {HORIZON_MIN} to {HORIZON_MAX} in steps of {HORIZON_STEP}"
        )
    return f"{minutes} minutes"


def campaign_totals(aggregates: DataFrame) -> DataFrame:
    """Clicks and users per campaign over all windows, most clicks first.

    Users are added up window by window, so one user counts once per window.
    """
    totals = aggregates.groupBy("campaign_id").agg(
        F.sum("clicks").alias("clicks"), F.sum("unique_users").alias("unique_users")
    )
    return totals.orderBy(F.desc("clicks"), "campaign_id")


def newest_end(aggregates: DataFrame) -> DataFrame:
    """One row: the greatest ``window_end`` present."""
    return aggregates.agg(F.max("window_end").alias("window_end"))


def latest_window(aggregates: DataFrame) -> DataFrame:
    """All rows of the newest window; none when the table is empty."""
    return aggregates.where(F.col("window_end") == newest_end(aggregates).scalar())


def trailing_windows(
    aggregates: DataFrame,
    ago: str,
    as_of: datetime | Column | DataFrame | None = None,
) -> DataFrame:
    """Windows that end later than ``ago`` before ``as_of`` (now by default), oldest first."""
    return _served(aggregates.where(F.col("window_end") > moment_before(as_of, ago)))


def _served(rows: DataFrame) -> DataFrame:
    columns = ["window_start", "window_end", "campaign_id", "clicks", "unique_users"]
    return rows.select(*columns).orderBy("window_start")


def stored_trailing_windows(
    spark: SparkSession,
    table: CampaignTable,
    ago: str,
    as_of: datetime | Column | DataFrame | None = None,
) -> DataFrame:
    """``trailing_windows`` of the file table, reading only the date folders it needs."""
    rows = table.latest(spark, since=moment_before(as_of, ago))
    return trailing_windows(rows, ago, as_of)


def recent_windows(
    events: DataFrame,
    width: str,
    ago: str,
    as_of: datetime | Column | DataFrame | None = None,
    **how: object,
) -> DataFrame:
    """Aggregate of the windows that end later than ``ago`` before ``as_of``, from raw events.

    Only the events of those windows are read and aggregated, not the whole history.
    """
    start = first_start(as_of, ago, width, events.schema["event_time"].dataType)
    return campaign_windows(events.where(F.col("event_time") >= start), width, **how)


def trailing_from_events(events: DataFrame, width: str, ago: str, **how: object) -> DataFrame:
    """``trailing_windows`` up to the newest window, from raw events."""
    newest = latest_window_end(events, width)
    rows = recent_windows(events, width, ago, newest, **how)
    return _served(rows)


def latest_from_events(events: DataFrame, width: str, **how: object) -> DataFrame:
    """``latest_window`` from raw events: the newest window is the one within its own width."""
    return recent_windows(events, width, width, latest_window_end(events, width), **how)


def dashboard_kpis(frame: DataFrame) -> DataFrame:
    """Rows, clicks, and users in the newest window; no row for an empty frame.

    One pass: sums per window first, then the newest window's sum goes along with the totals.
    """
    per_window = frame.groupBy("window_end").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("clicks").alias("clicks"),
        F.sum("unique_users").alias("users"),
    )
    totals = per_window.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("total_rows"),
        F.sum("clicks").cast("long").alias("clicks"),
        F.max_by("users", "window_end").cast("long").alias("latest_unique_users"),
    )
    return totals.where("total_rows > 0")


def clicks_by_campaign(frame: DataFrame, campaigns: Sequence[str] | None = None) -> DataFrame:
    """Clicks per window start and campaign, in rows (time, campaign_id, clicks).

    Every window start of the frame has a row for every campaign of the frame, zero where there are
    none; with a list of campaigns the rows of others are kept too.
    """
    names = frame.select("campaign_id").distinct()
    if campaigns:
        wanted = frame.sparkSession.createDataFrame([(name,) for name in campaigns], "campaign_id string")
        names = names.unionByName(wanted).distinct()
    clicks = frame.groupBy("window_start", "campaign_id").agg(F.sum("clicks").alias("clicks"))
    # The windows meet in one row, so a frame that is too long to be shown is refused.
    starts = frame.select("window_start").distinct()
    too_many = F.raise_error(F.lit(f"more than {MAX_SHOWN_WINDOWS} windows to show"))
    listed = F.collect_list("window_start")
    times = starts.limit(MAX_SHOWN_WINDOWS + 1).agg(
        F.when(F.count(F.lit(1)) <= MAX_SHOWN_WINDOWS, listed)
        .otherwise(too_many.cast(ArrayType(frame.schema["window_start"].dataType)))
        .alias("at")
    )
    grid = names.withColumn("window_start", F.explode(times.scalar()))
    filled = grid.join(clicks, ["window_start", "campaign_id"], "left")
    return filled.select(
        F.col("window_start").alias("time"),
        "campaign_id",
        F.coalesce("clicks", F.lit(0)).alias("clicks"),
    ).orderBy("time", "campaign_id")


def clicks_over_time(frame: DataFrame, campaigns: Sequence[str] | None = None) -> DataFrame:
    """One row per window start, one column of clicks per campaign, zero where there are none.

    With the campaign names given this is one aggregate with one sum per name, and clicks of others
    are added up in a column ``other``, so that nothing is lost. Without, Spark looks the names up
    first and refuses more than ``spark.sql.pivotMaxValues``; ``clicks_by_campaign`` has no limit.
    """
    if campaigns is None:
        wide = frame.groupBy("window_start").pivot("campaign_id").agg(F.sum("clicks"))
        wide = wide.na.fill(0)
    else:
        known = F.coalesce(F.col("campaign_id").isin(*campaigns), F.lit(False))
        columns = [
            F.sum(F.when(F.col("campaign_id") == name, F.col("clicks")).otherwise(0)).alias(name)
            for name in campaigns
        ]
        other = F.sum(F.when(~known, F.col("clicks")).otherwise(0)).alias("other")
        wide = frame.groupBy("window_start").agg(*columns, other)
    return wide.withColumnRenamed("window_start", "time").orderBy("time")


def ranked(rows: DataFrame) -> DataFrame:
    """Rows of one window, most clicks first, with their position."""
    order = [F.desc("clicks"), F.asc("campaign_id")]
    return global_rank(rows, order, "position").orderBy("position")


def latest_window_ranked(frame: DataFrame) -> DataFrame:
    """Campaigns of the newest window in the frame, most clicks first, with their position."""
    return ranked(latest_window(frame))


def stored_latest_window(spark: SparkSession, table: CampaignTable) -> DataFrame:
    """``latest_window`` of the file table: the rows of its last date that end when it ends.

    The end comes from the files' footers, so the rows are filtered at the scan.
    """
    newest = table.newest_end(spark)
    if newest is None:
        return table.latest(spark)
    return table.latest(spark, since=newest).where(F.col("window_end") == F.lit(newest))


def register_views(
    spark: SparkSession,
    table: CampaignTable,
    prefix: str = "",
    totals: DataFrame | None = None,
) -> None:
    """Temp views over the table as it is now: files are listed again, nothing is computed.

    ``totals`` are kept totals per campaign; without them the view adds up the whole table.
    """
    current = table.latest(spark)
    current.createOrReplaceTempView(f"{prefix}campaign_agg")
    stored_latest_window(spark, table).createOrReplaceTempView(f"{prefix}latest_campaign_window")
    shown = campaign_totals(current if totals is None else totals)
    shown.createOrReplaceTempView(f"{prefix}campaign_totals")
