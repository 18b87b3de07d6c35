from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clicktide.functions.times import align_to_window, duration, first_start, floor_point, micros
from clicktide.operators.windows import campaign_windows, latest_window_end
from clicktide.plans.serving import latest_window, latest_from_events, recent_windows
from clicktide.plans.serving import trailing_windows
from helpers import at, plan, tuples

SCHEMA = "event_time timestamp, user_id string, campaign_id string"


def _events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_window_borders_are_half_open(spark):
    events = _events(
        spark, [(at("23:44:09.999"), "a", "x"), (at("23:44:10"), "a", "x"), (None, "a", "x")]
    )
    rows = campaign_windows(events, users="exact").orderBy("window_start").collect()
    assert [(r.window_start.second, r.window_end.second, r.clicks) for r in rows] == [
        (0, 10, 1),
        (10, 20, 1),
    ]
    assert all(r.ctr is None for r in rows)


@pytest.mark.parametrize("users", ["exact", "approx"])
def test_null_users_are_counted_as_clicks_only(spark, users):
    events = _events(spark, [(at("00:00:01"), None, "x"), (at("00:00:02"), "a", "x")])
    row = campaign_windows(events, users=users).first()
    assert (row.clicks, row.unique_users) == (2, 1)


def test_unknown_user_count_is_refused(spark):
    with pytest.raises(ValueError):
        campaign_windows(_events(spark, []), users="sample")


def test_empty_input(spark):
    empty = _events(spark, [])
    assert campaign_windows(empty).count() == 0
    assert latest_from_events(empty, "10 seconds").count() == 0
    assert recent_windows(empty, "10 seconds", "1 minute", at("00:00:00")).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.integers(-100, 400), st.sampled_from("abc"), st.sampled_from("xyz")),
        min_size=1,
        max_size=40,
    )
)
def test_against_counting_by_hand(spark, rows):
    base = datetime(1970, 1, 1)
    events = spark.createDataFrame(
        [(base + timedelta(seconds=s), u, c) for s, u, c in rows],
        "event_time timestamp_ntz, user_id string, campaign_id string",
    )
    clicks, users = defaultdict(int), defaultdict(set)
    for second, user, campaign in rows:
        key = (base + timedelta(seconds=second // 10 * 10), campaign)
        clicks[key] += 1
        users[key].add(user)
    expected = sorted((s, c, n, len(users[s, c])) for (s, c), n in clicks.items())
    exact = campaign_windows(events, users="exact")
    assert tuples(exact.select("window_start", "campaign_id", "clicks", "unique_users")) == expected


def test_hot_campaign_is_spread_over_users(spark):
    events = spark.range(30000).select(
        F.lit(at("12:00:00")).alias("event_time"),
        F.concat(F.lit("u"), F.col("id") % 7000).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50))
        .alias("campaign_id"),
    )
    exact = campaign_windows(events, users="exact")
    text = plan(exact)
    first = [line for line in text.splitlines() if "Exchange hashpartitioning" in line][-1]
    assert "user_id" in first and "partial_count" in text
    hot = exact.where("campaign_id = 'hot'").first()
    assert hot.clicks == 10000
    assert hot.unique_users == len({i % 7000 for i in range(0, 30000, 3)})


def test_align(spark):
    frame = spark.createDataFrame([(at("23:44:09.999"),), (at("23:44:10"),)], "t timestamp")
    rows = align_to_window(frame, "t").orderBy("t").collect()
    assert [r.window_start.second for r in rows] == [0, 10]


def test_durations():
    assert micros("10 seconds") == 10_000_000
    assert micros("1 hour 30 minutes") == 5_400_000_000
    assert micros("1 day") == 86_400_000_000
    for wrong in ("", "ten seconds", "10", "10 seconds; drop", "1 month"):
        with pytest.raises(ValueError):
            duration(wrong)


def test_floor_point_works_before_the_epoch(spark):
    point = F.lit("1969-12-31 23:59:55").cast("timestamp")
    row = spark.range(1).select(floor_point(point, "10 seconds").cast("string").alias("t")).first()
    assert row.t == "1969-12-31 23:59:50"


@pytest.mark.parametrize("as_of", ["10:00:00", "10:00:03", "09:59:59.999"])
@pytest.mark.parametrize("ago", ["1 minute", "65 seconds", "10 seconds"])
def test_event_bound_is_the_same_as_the_bound_on_window_ends(spark, as_of, ago):
    start = datetime(2025, 10, 4, 9, 58)
    events = spark.createDataFrame(
        [(start + timedelta(milliseconds=500 * i), str(i), "x") for i in range(300)], SCHEMA
    )
    columns = ["window_start", "window_end", "campaign_id", "clicks", "unique_users"]
    want = trailing_windows(campaign_windows(events, users="exact"), ago, at(as_of))
    got = recent_windows(events, "10 seconds", ago, at(as_of), users="exact").select(*columns)
    assert tuples(got) == tuples(want)
    assert want.count() > 0


def test_latest_from_events_is_the_latest_window(spark):
    events = _events(
        spark,
        [(at("10:00:00"), "a", "x"), (at("10:00:11"), "a", "x"), (at("10:00:19"), "b", "y")],
    )
    all_windows = campaign_windows(events, users="exact")
    got = latest_from_events(events, "10 seconds", users="exact")
    assert tuples(got) == tuples(latest_window(all_windows))
    assert got.count() == 2
    assert latest_window_end(events).first().window_end == at("10:00:20").replace(tzinfo=None)


def test_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    _events(spark, [(at("10:00:00"), "a", "x")]).write.parquet(path)
    events = spark.read.parquet(path)
    literal = plan(recent_windows(events, "10 seconds", "1 minute", at("10:00:00")))
    assert "GreaterThanOrEqual(event_time,2025-10-04" in literal
    looked_up = plan(latest_from_events(events, "10 seconds"))
    assert "GreaterThanOrEqual(event_time,ScalarSubquery" in looked_up
    kind = events.schema["event_time"].dataType
    now = plan(events.where(F.col("event_time") >= first_start(None, "1 hour", "1 hour", kind)))
    assert "PushedFilters: [IsNotNull(event_time), GreaterThanOrEqual(event_time," in now


def test_only_needed_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "events")
    _events(spark, [(at("10:00:00"), "a", "x")]).withColumn("ad_id", F.lit("z")).write.parquet(path)
    assert "ad_id" not in plan(campaign_windows(spark.read.parquet(path)))
