import json
import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from clicktide.functions.codec import AGGREGATE_FIELDS, decode_events, decode_rejects
from clicktide.operators.database import DatabaseUpsert
from clicktide.operators.table import CampaignTable
from clicktide.operators.windows import campaign_windows
from clicktide.sources.events import (
    EVENT_TABLE_SCHEMA,
    event_table_rejects,
    event_table_stream,
    landed_batch,
    landed_stream,
)
from clicktide.streaming.accounts import ACCOUNTS_SCHEMA, RowAccounts, observed, row_accounts
from clicktide.streaming.refresh import ServingRefresh
from clicktide.streaming.replay import land_in_order, publish_to_files, replay
from clicktide.streaming.runner import (
    StreamSettings,
    database_sink,
    finish,
    finish_all,
    start_append_stream,
    start_campaign_stream,
    start_rejects_stream,
    table_sink,
    windowed_stream,
)
from clicktide.streaming.state import state_operators, windows_in_state
from helpers import agg_rows, at, message, plan, tuples
from journal import Connect, notes

TIMEOUT = 120


class Landing:
    """A folder of JSON lines; files are taken in the order they are put there."""

    def __init__(self, path):
        self.path, self._count = str(path), 0
        os.mkdir(self.path)

    def put(self, *lines):
        name = os.path.join(self.path, f"part-{self._count:03d}.txt")
        with open(name, "w") as out:
            out.write("\n".join(lines) + "\n")
        stamp = 1_700_000_000 + self._count
        os.utime(name, (stamp, stamp))
        self._count += 1


@pytest.fixture()
def landing(tmp_path):
    return Landing(tmp_path / "landing")


@pytest.fixture()
def table(tmp_path):
    return CampaignTable(str(tmp_path / "agg"))


@pytest.fixture()
def settings(tmp_path):
    return StreamSettings(str(tmp_path / "checkpoint"), trigger=None, state_partitions=2)


def _noting(table, seen):
    """Table sink that notes what each batch wrote.

    Read back from the table, since a second action on the batch would run its aggregate again.
    """

    def note(batch, batch_id):
        spark = batch.sparkSession
        rows = table.changelog(spark).where(F.col("version") == max(table.done(spark)))
        seen[batch_id] = _clicks(rows)

    return table_sink(table, then=note)


def _run(spark, landing, sink, settings, files=1):
    events = decode_events(landed_stream(spark, landing.path, files))
    query = start_campaign_stream(events, sink, settings)
    finish(query, TIMEOUT)
    return query


def _clicks(df):
    return sorted((r.window_start.second, r.campaign_id, r.clicks) for r in df.collect())


def test_late_rows(spark, landing, table, settings):
    landing.put(message("23:44:01"), message("23:44:09.999"), "garbage")
    landing.put(message("23:44:02"), message("23:44:55"))
    landing.put(message("23:44:03"), message("23:44:21"), message("23:44:56"))
    landing.put(message("23:44:04"), message("23:44:57"))
    seen = {}
    query = _run(spark, landing, _noting(table, seen), settings)
    assert seen[0] == [(0, "cmp-001", 2)]
    assert seen[1] == [(0, "cmp-001", 3), (50, "cmp-001", 1)]
    # A batch drops late rows by the watermark of the batch before it.
    assert seen[2] == [(0, "cmp-001", 4), (20, "cmp-001", 1), (50, "cmp-001", 2)]
    assert seen[3] == [(50, "cmp-001", 3)]
    dropped = {
        p["batchId"]: sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])
        for p in query.recentProgress
    }
    assert [dropped[i] for i in range(4)] == [0, 0, 0, 1]
    assert _clicks(table.latest(spark)) == [
        (0, "cmp-001", 4),
        (20, "cmp-001", 1),
        (50, "cmp-001", 3),
    ]


def test_only_changed_windows_are_sent_again(spark, landing, table, settings):
    landing.put(message("10:00:01"), message("10:00:11", campaign="cmp-002"))
    landing.put(message("10:00:02", user="u-2"))
    seen = {}
    _run(spark, landing, _noting(table, seen), settings)
    assert seen[1] == [(0, "cmp-001", 2)]
    users = {r.campaign_id: r.unique_users for r in table.latest(spark).collect()}
    assert users == {"cmp-001": 2, "cmp-002": 1}


def test_restart_goes_on_from_the_checkpoint(spark, landing, table, settings):
    landing.put(message("10:00:01"))
    seen = {}
    _run(spark, landing, _noting(table, seen), settings)
    landing.put(message("10:00:02"))
    _run(spark, landing, _noting(table, seen), settings)
    # The second run read the second file only, yet sends the window's full total.
    assert [rows for rows in seen.values() if rows] == [
        [(0, "cmp-001", 1)],
        [(0, "cmp-001", 2)],
    ]
    batches = len(seen)
    _run(spark, landing, _noting(table, seen), settings)
    assert _clicks(table.latest(spark)) == [(0, "cmp-001", 2)]
    assert len(seen) <= batches + 1


def test_failed_batch_is_replayed_without_doubling(spark, landing, table, settings):
    landing.put(message("10:00:01"), message("10:00:02"))

    def failing(batch, batch_id):
        table_sink(table)(batch, batch_id)
        raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        _run(spark, landing, failing, settings)
    landing.put(message("10:00:03"))
    seen = {}
    _run(spark, landing, _noting(table, seen), settings)
    assert seen[0] == [(0, "cmp-001", 2)]
    assert _clicks(table.latest(spark)) == [(0, "cmp-001", 3)]


def test_a_new_checkpoint_is_another_writer(spark, landing, table, settings, tmp_path):
    landing.put(message("10:00:01"))
    landing.put(message("10:00:02"))
    _run(spark, landing, table_sink(table), settings)
    again = StreamSettings(str(tmp_path / "checkpoint2"), trigger=None, state_partitions=2)
    landing.put(message("10:00:03"))
    _run(spark, landing, table_sink(table), again, files=10)
    assert _clicks(table.latest(spark)) == [(0, "cmp-001", 3)]


def test_state_partitions_are_frozen_and_the_session_is_left_alone(spark, landing, table, settings):
    landing.put(message("10:00:01"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    _run(spark, landing, table_sink(table), settings)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    state = os.path.join(settings.checkpoint, "state", "0")
    assert sorted(n for n in os.listdir(state) if n.isdigit()) == ["0", "1"]


def test_a_batch_makes_one_small_file_per_date(spark, landing, table, tmp_path):
    lines = [message("10:00:01", campaign=f"c{i}") for i in range(50)]
    landing.put(*lines, *(line.replace("10-04", "10-05") for line in lines))
    settings = StreamSettings(str(tmp_path / "checkpoint"), trigger=None, state_partitions=4)
    _run(spark, landing, table_sink(table), settings)
    files = table.changelog(spark).select(F.input_file_name()).distinct().count()
    assert files == 2
    assert table.latest(spark).count() == 100


def test_state_on_disk_gives_the_same(spark, landing, table, tmp_path):
    landing.put(message("10:00:01"))
    landing.put(message("10:00:02", user="u-2"))
    settings = StreamSettings(
        str(tmp_path / "checkpoint"), trigger=None, state_partitions=2, large_state=True
    )
    _run(spark, landing, table_sink(table), settings)
    assert _clicks(table.latest(spark)) == [(0, "cmp-001", 2)]


def test_processing_time_trigger(spark, landing, table, tmp_path):
    landing.put(message("10:00:01"))
    settings = StreamSettings(str(tmp_path / "checkpoint"), trigger="1 second", state_partitions=2)
    events = decode_events(landed_stream(spark, landing.path))
    query = start_campaign_stream(events, table_sink(table), settings)
    try:
        query.processAllAvailable()
        assert query.isActive
        assert _clicks(table.latest(spark)) == [(0, "cmp-001", 1)]
    finally:
        query.stop()


def test_finish_gives_up(spark, landing, table, tmp_path):
    settings = StreamSettings(str(tmp_path / "checkpoint"), trigger="1 second", state_partitions=2)
    query = start_campaign_stream(
        decode_events(landed_stream(spark, landing.path)), table_sink(table), settings
    )
    with pytest.raises(TimeoutError):
        finish(query, 1)
    assert not query.isActive


def test_files_per_batch_are_limited(spark, landing, table, settings):
    for second in range(5):
        landing.put(message(f"10:00:0{second}"))
    query = _run(spark, landing, table_sink(table), settings, files=2)
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sizes == [2, 2, 1]


def test_bytes_per_batch_are_limited(spark, landing, table, settings):
    """Files of unequal size: a batch stays below the bound, or is one file."""
    sizes = [1, 1, 6, 2, 2, 9, 1]
    for n in sizes:
        landing.put(*[message(f"10:00:0{i}") for i in range(n)])
    line = len(message("10:00:01")) + 1
    raw = landed_stream(spark, landing.path, max_bytes_per_trigger=4 * line)
    query = start_campaign_stream(decode_events(raw), table_sink(table), settings)
    finish(query, TIMEOUT)
    rows = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(rows) == sum(sizes) and all(n <= 4 or n in (6, 9) for n in rows)
    assert 2 < len(rows) < len(sizes)
    with pytest.raises(ValueError):
        landed_stream(spark, landing.path, 1, 1)


def test_old_files_are_taken_too(spark, landing, table, settings):
    """A file that is more than a week older than those of the batch before."""
    landing.put(message("10:00:01"))
    _run(spark, landing, table_sink(table), settings)
    landing.put(message("10:00:02"))
    old = os.path.join(landing.path, "part-001.txt")
    os.utime(old, (1_600_000_000, 1_600_000_000))
    _run(spark, landing, table_sink(table), settings)
    assert _clicks(table.latest(spark)) == [(0, "cmp-001", 2)]


def test_database_sink(spark, landing, settings, tmp_path):
    landing.put(message("10:00:01"), message("10:00:02", campaign="cmp-002"))
    folder = tmp_path / "notes"
    folder.mkdir()
    _run(spark, landing, database_sink(DatabaseUpsert(Connect(str(folder)))), settings)
    rows = [row for c in notes(folder, "commit") for s in c for row in s["rows"]]
    assert sorted((row[2], row[3]) for row in rows) == [("cmp-001", "1"), ("cmp-002", "1")]


def test_compaction_beside_a_stream(spark, landing, table, settings):
    for second in range(1, 5):
        landing.put(message(f"10:00:0{second}"))

    def fold(batch, batch_id):
        table.compact(spark)
        table.vacuum(spark, retention_seconds=0)

    _run(spark, landing, table_sink(table, then=fold), settings)
    # The last batch, which only moves the watermark, is empty.
    assert len(table.unfolded(spark)) <= 1 and table.changelog(spark).count() == 1
    assert _clicks(table.latest(spark)) == [(0, "cmp-001", 4)]


def test_a_failed_stream_ends_the_others(spark, landing, table, tmp_path):
    landing.put(message("10:00:01"))
    running = StreamSettings(str(tmp_path / "c1"), trigger="1 second", state_partitions=2)
    failing = StreamSettings(str(tmp_path / "c2"), trigger="1 second", state_partitions=2)

    def fail(batch, batch_id):
        raise RuntimeError("gone")

    events = decode_events(landed_stream(spark, landing.path))
    queries = [
        start_campaign_stream(events, table_sink(table), running),
        start_campaign_stream(events, fail, failing),
    ]
    with pytest.raises(Exception, match="gone"):
        finish_all(queries)
    assert not any(query.isActive for query in queries)


def test_state_is_bounded_by_the_watermark(spark, table, settings, tmp_path):
    query = replay(_history(spark, 2000), str(tmp_path / "land"), table_sink(table), settings, 6)
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    assert sum(state["numRowsDroppedByWatermark"] for state in states) == 0
    assert table.latest(spark).agg(F.sum("clicks")).first()[0] == 2000
    # The whole history has over 1,800 windows and campaigns; a batch has a sixth of them.
    assert max(state["numRowsTotal"] for state in states) < table.latest(spark).count() / 2.5


def test_a_replay_started_again_lands_nothing_twice(spark, table, settings, tmp_path):
    history, land = _history(spark, 500), str(tmp_path / "land")
    for _ in range(2):
        replay(history, land, table_sink(table), settings, 3, timeout=TIMEOUT)
    assert table.latest(spark).agg(F.sum("clicks")).first()[0] == 500
    assert landed_batch(spark, land).count() == 500


def test_landed_hours_are_pruned(spark, tmp_path):
    land = str(tmp_path / "land")
    publish_to_files(_history(spark, 500), land)
    rows = landed_batch(spark, land, at("11:00:00"))
    assert "PartitionFilters: [isnotnull(event_" in plan(rows) or "event_hour" in plan(rows)
    everything = decode_events(landed_batch(spark, land)).where(
        F.col("event_time") >= F.lit(at("11:00:00"))
    )
    assert decode_events(rows).count() == everything.count() > 0


def test_rejects_stream(spark, landing, tmp_path):
    landing.put(message("10:00:01"), "garbage", message("10:00:01", campaign=None))
    settings = StreamSettings(str(tmp_path / "checkpoint"), trigger=None)
    out = str(tmp_path / "rejects")
    finish(start_rejects_stream(landed_stream(spark, landing.path), out, settings), TIMEOUT)
    stored = spark.read.parquet(out)
    assert sorted(r.reason for r in stored.collect()) == ["no_campaign", "not_an_event"]
    batch = decode_rejects(landed_batch(spark, landing.path))
    assert tuples(stored) == tuples(batch)


def _history(spark, rows=4000):
    """Events of a bit more than an hour in no order, a third of them in one campaign."""
    second = F.pmod(F.col("id") * 7919, F.lit(4001))
    return spark.range(rows).select(
        F.timestamp_seconds(F.lit(int(at("10:00:00").timestamp())) + second).alias("event_time"),
        F.concat(F.lit("u"), F.col("id") % 97).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5))
        .alias("campaign_id"),
        F.lit("ad").alias("ad_id"),
        F.lit(True).alias("clicked"),
    )


def test_replayed_stream_equals_batch(spark, table, settings, tmp_path):
    history = _history(spark)
    query = replay(history, str(tmp_path / "land"), table_sink(table), settings, 5, 2, TIMEOUT)
    streamed = table.latest(spark).drop("unique_users", "ctr")
    batch = campaign_windows(history, users="exact").drop("unique_users", "ctr")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert streamed.agg(F.sum("clicks")).first()[0] == 4000
    # One stream, a batch for each two files.
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5


def test_files_are_landed_in_the_order_of_time(spark, tmp_path):
    folder = str(tmp_path / "land")
    history = _history(spark, 1000).unionByName(_history(spark, 3).withColumn("event_time", F.lit(None)))
    land_in_order(history, folder, 4, write=lambda rows, path: rows.write.parquet(path))
    rows = spark.read.parquet(folder).select("event_time", F.col("_metadata.file_modification_time").alias("at"))
    ends = rows.groupBy("at").agg(F.min("event_time"), F.max("event_time"), F.count("*")).orderBy("at").collect()
    assert len(ends) == 4 and sum(r[3] for r in ends) == 1000
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:]))
    assert max(r[3] for r in ends) < 400
    text = plan(history.repartitionByRange(4, "event_time"))
    assert text.count("Range (") == 2 and text.count("Exchange rangepartitioning") == 1


def test_an_empty_history(spark, table, settings, tmp_path):
    replay(_history(spark, 0), str(tmp_path / "land"), table_sink(table), settings, 3, timeout=TIMEOUT)
    assert table.latest(spark).count() == 0


def test_rows_that_cannot_be_used_are_kept_with_a_reason(spark, tmp_path):
    folder, rejects = str(tmp_path / "in"), str(tmp_path / "rejects")
    ts = at("10:00:00").replace(tzinfo=None)
    rows = [(1, ts, 1, "click", 0.5, '{"k": 3}'), (2, None, 1, "view", None, '{"k": 3}')]
    rows += [(3, ts, None, "view", 1.0, "{}"), (4, ts, 2, "view", 1.0, None), (5, None, None, None, None, None)]
    spark.createDataFrame(rows, EVENT_TABLE_SCHEMA).write.parquet(folder)
    kept = str(tmp_path / "kept")
    settings = StreamSettings(str(tmp_path / "c1"), trigger=None)
    finish(start_append_stream(event_table_rejects(spark, folder), rejects, settings), TIMEOUT)
    settings = StreamSettings(str(tmp_path / "c2"), trigger=None)
    finish(start_append_stream(event_table_stream(spark, folder), kept, settings), TIMEOUT)
    found = spark.read.parquet(rejects).collect()
    assert sorted((json.loads(r.value)["event_id"], r.reason) for r in found) == [
        (2, "no_event_time"), (3, "no_campaign"), (4, "no_campaign"), (5, "no_event_time")
    ]
    assert spark.read.parquet(kept).count() + len(found) == len(rows)


def test_refresh_keeps_to_its_ttl(spark, table):
    now = [100.0]
    refresh = ServingRefresh(spark, table, "r_", clock=lambda: now[0])
    start = at("10:00:00")
    row = (start, start + timedelta(seconds=10), "x", 5, 3)
    table.upsert(agg_rows(spark, [row]))
    assert refresh() is True
    table.upsert(agg_rows(spark, [(*row[:3], 8, 3)]))
    now[0] += 4.9
    assert refresh() is False
    assert spark.table("r_campaign_totals").first().clicks == 5
    now[0] += 0.2
    assert refresh() is True
    assert spark.table("r_campaign_totals").first().clicks == 8


def test_refresh_runs_after_each_batch(spark, landing, table, settings):
    landing.put(message("10:00:01"))
    refresh = ServingRefresh(spark, table, "s_", ttl=0)
    _run(spark, landing, table_sink(table, then=refresh), settings)
    assert _clicks(spark.table("s_latest_campaign_window")) == [(0, "cmp-001", 1)]


def test_stream_has_no_python_and_reads_each_message_once(spark, landing, settings):
    landing.put(message("10:00:01"))
    text = plan(windowed_stream(decode_events(landed_batch(spark, landing.path)), settings))
    assert "Python" not in text and text.count("from_json") == 1


def test_every_message_is_accounted_for(spark, landing, table, settings, tmp_path):
    landing.put(message("23:44:01"), message("23:44:09.999"), "garbage")
    landing.put(message("23:44:02"), message("23:44:55"), message("23:44:02", campaign=None))
    landing.put(message("23:44:03"), message("23:44:21"), message("23:44:56"))
    # Two late events of one window and campaign are one group for the state, yet two events.
    landing.put(message("23:44:04"), message("23:44:04", user="u-2"), message("23:44:57"))
    books = str(tmp_path / "books")
    with RowAccounts(spark, books) as accounts:
        raw = landed_stream(spark, landing.path, 1)
        events = decode_events(raw, fields=AGGREGATE_FIELDS, watch=observed)
        finish(accounts.follow(start_campaign_stream(events, table_sink(table), settings)), TIMEOUT)
    row = row_accounts(spark, books, table).first()
    assert row.asDict() == {"messages": 12, "rejected": 2, "late": 2, "kept": 8}
    by_batch = spark.read.schema(ACCOUNTS_SCHEMA).json(books).orderBy("batch_id").collect()
    assert [r.messages for r in by_batch if r.messages] == [3, 3, 3, 3]
    assert [r.rejected for r in by_batch if r.messages] == [1, 1, 0, 0]
    assert [r.groups_dropped for r in by_batch if r.messages] == [0, 0, 0, 1]
    text = plan(decode_events(landed_batch(spark, landing.path), watch=observed))
    assert text.count("from_json") == 1


def test_accounts_of_a_stream_that_starts_again(spark, landing, table, settings, tmp_path):
    books = str(tmp_path / "books")
    for second in (1, 2):
        landing.put(message(f"10:00:0{second}"), "garbage")
        with RowAccounts(spark, books) as accounts:
            events = decode_events(landed_stream(spark, landing.path), watch=observed)
            finish(accounts.follow(start_campaign_stream(events, table_sink(table), settings)), TIMEOUT)
    row = row_accounts(spark, books, table).first()
    assert row.asDict() == {"messages": 4, "rejected": 2, "late": 0, "kept": 2}


def test_state_is_read_from_the_checkpoint(spark, landing, table, settings):
    landing.put(message("10:00:01"), message("10:00:41", campaign="cmp-002"))
    landing.put(message("10:00:45", campaign="cmp-003"))
    _run(spark, landing, table_sink(table), settings)
    rows = windows_in_state(spark, settings.checkpoint).collect()
    # The watermark, 10:00:15, has closed the first window.
    assert sorted((r.window_end.second, r.campaign_id) for r in rows) == [(50, "cmp-002"), (50, "cmp-003")]
    operator = state_operators(spark, settings.checkpoint).first()
    assert operator.operatorName == "stateStoreSave" and operator.numPartitions == 2
