from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from clicktide.operators.grid import fill_grid, window_grid
from clicktide.operators.rank import global_rank
from clicktide.plans import serving
from clicktide.plans.backfill import backfill
from helpers import agg_rows, at, plan, tuples

W1, W2, W3 = at("10:00:00"), at("10:00:10"), at("10:00:20")
STEP = timedelta(seconds=10)


@pytest.fixture()
def frame(spark):
    return agg_rows(
        spark,
        [
            (W1, W1 + STEP, "x", 5, 3),
            (W1, W1 + STEP, "y", 7, 2),
            (W2, W2 + STEP, "x", 1, 1),
            (W3, W3 + STEP, "y", 4, 4),
            (W3, W3 + STEP, "x", 4, 2),
            (W3, W3 + STEP, "z", 9, 9),
        ],
    )


def test_totals_are_sorted(frame):
    rows = serving.campaign_totals(frame).collect()
    assert [tuple(r) for r in rows] == [("y", 11, 6), ("x", 10, 6), ("z", 9, 9)]


def test_latest_window(frame):
    rows = serving.latest_window(frame)
    assert rows.columns == frame.columns
    assert sorted(r.campaign_id for r in rows.collect()) == ["x", "y", "z"]


def test_trailing_bound_is_strict_and_sorted(frame):
    rows = serving.trailing_windows(frame, "15 seconds", at("10:00:25")).collect()
    assert [r.campaign_id for r in rows][0] == "x" and len(rows) == 4
    starts = [r.window_start for r in rows]
    assert starts == sorted(starts)
    assert "ctr" not in rows[0]


def test_default_point_in_time_is_now(spark, frame):
    assert serving.trailing_windows(frame, "15 minutes").count() == 0
    fresh = frame.withColumn("window_end", F.current_timestamp())
    assert serving.trailing_windows(fresh, "15 minutes").count() == 6


def test_horizons():
    assert serving.horizon() == "15 minutes"
    assert serving.horizon(120) == "120 minutes"
    for wrong in (0, 7, 125):
        with pytest.raises(ValueError):
            serving.horizon(wrong)


def test_kpis(frame):
    assert tuple(serving.dashboard_kpis(frame).first()) == (6, 30, 15)


def test_pivot_with_and_without_names(frame):
    expected = [(5, 7, 0), (1, 0, 0), (4, 4, 9)]
    wide = serving.clicks_over_time(frame)
    assert wide.columns == ["time", "x", "y", "z"]
    assert [tuple(r)[1:] for r in wide.collect()] == expected
    named = serving.clicks_over_time(frame, ["x", "y", "z"])
    assert named.columns == ["time", "x", "y", "z", "other"]
    assert [tuple(r)[1:] for r in named.collect()] == [(*row, 0) for row in expected]


def test_pivot_loses_no_campaign(frame):
    wide = serving.clicks_over_time(frame, ["x"]).collect()
    assert [(r.x, r.other) for r in wide] == [(5, 7), (1, 0), (4, 13)]
    long = serving.clicks_by_campaign(frame, ["new"]).collect()
    assert len(long) == 3 * 4 and sum(r.clicks for r in long) == 30
    assert [r.clicks for r in long if r.campaign_id == "new"] == [0, 0, 0]


def test_named_pivot_is_one_aggregate(frame):
    text = plan(serving.clicks_over_time(frame, ["x", "y", "z"]))
    assert text.count("Exchange hashpartitioning") == 1


def test_rank_breaks_ties_by_name(frame):
    rows = serving.latest_window_ranked(frame).collect()
    assert [(r.position, r.campaign_id) for r in rows] == [(1, "z"), (2, "x"), (3, "y")]


def test_empty_table_gives_empty_results(spark, frame):
    empty = frame.where("false")
    for result in (
        serving.campaign_totals(empty),
        serving.latest_window(empty),
        serving.trailing_windows(empty, "15 minutes", W1),
        serving.dashboard_kpis(empty),
        serving.clicks_over_time(empty),
        serving.clicks_over_time(empty, ["x"]),
        serving.clicks_by_campaign(empty),
        serving.latest_window_ranked(empty),
    ):
        assert result.count() == 0


def test_global_rank_over_many_partitions(spark):
    numbers = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 11).alias("v"), "id"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = global_rank(numbers, [F.desc("v"), F.asc("id")])
        assert got.rdd.getNumPartitions() > 1
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(((r.v, r.id) for r in numbers.collect()), key=lambda p: (-p[0], p[1]))
    assert [(r.v, r.id) for r in sorted(rows, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in rows) == list(range(1, 5001))


def test_grid(spark):
    names = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "campaign_id string")
    grid = window_grid(names, 3, "10 seconds", at("10:00:29.5"))
    ends = [W3, W2, W1]
    assert tuples(grid) == sorted(
        ((end - STEP).replace(tzinfo=None), end.replace(tzinfo=None), c)
        for end in ends
        for c in "xy"
    )
    assert "CartesianProduct" not in plan(grid) and "NestedLoop" not in plan(grid)
    with pytest.raises(ValueError):
        window_grid(names, 0)


def test_filled_grid_has_no_holes(spark, frame):
    names = spark.createDataFrame([("x",), ("y",)], "campaign_id string")
    rows = fill_grid(window_grid(names, 4, "10 seconds", W3 + STEP), frame)
    clicks = {(r.window_start.second, r.window_start.minute, r.campaign_id): r.clicks
              for r in rows.collect()}
    assert clicks == {
        (50, 59, "x"): 0, (50, 59, "y"): 0,
        (0, 0, "x"): 5, (0, 0, "y"): 7,
        (10, 0, "x"): 1, (10, 0, "y"): 0,
        (20, 0, "x"): 4, (20, 0, "y"): 4,
    }


def test_backfill_from_events(spark):
    events = spark.createDataFrame(
        [(W1, "a", "x"), (W1, "b", "x"), (W3, "a", "y"), (at("09:00:00"), "a", "old")],
        "event_time timestamp, user_id string, campaign_id string",
    )
    names = spark.createDataFrame([("x",), ("y",)], "campaign_id string")
    rows = backfill(events, names, 3, "10 seconds", W3 + STEP).collect()
    assert len(rows) == 6
    assert sum(r.clicks for r in rows) == 3 and sum(r.unique_users for r in rows) == 3
    # Without names, those of the events in these windows.
    assert backfill(events, None, 3, "10 seconds", W3 + STEP).count() == 6


def test_frames_that_are_too_long_to_show_are_refused(frame, monkeypatch):
    assert serving.clicks_by_campaign(frame).count() == 9
    monkeypatch.setattr(serving, "MAX_SHOWN_WINDOWS", 2)
    with pytest.raises(Exception, match="more than 2 windows"):
        serving.clicks_by_campaign(frame).collect()
