"""Batches that reach a database whole or not at all; the database is a file of this process's user."""

import sqlite3
from dataclasses import dataclass
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from clicktide.contracts import create_table_sql
from clicktide.operators.database import DatabaseUpsert
from clicktide.operators.staged import StagedUpsert, StagedWriter, create_staging_sql
from clicktide.streaming.runner import database_sink
from helpers import agg_rows, at

W1 = at("10:00:00")
STEP = timedelta(seconds=10)


@dataclass(frozen=True)
class Connect:
    path: str

    def __call__(self):
        return sqlite3.connect(self.path, timeout=60)


@pytest.fixture()
def upsert(tmp_path):
    made = StagedUpsert(DatabaseUpsert(Connect(str(tmp_path / "agg.db")), flush_rows=7))
    with made.upsert.connect() as connection:
        connection.execute(create_table_sql())
        connection.execute(create_staging_sql("campaign_agg_staging"))
    return made


def _read(upsert, table="campaign_agg"):
    with upsert.upsert.connect() as connection:
        return sorted(connection.execute(f"SELECT campaign_id, clicks, window_start FROM {table}"))


def _rows(spark, n, clicks=None):
    return spark.range(n).select(
        F.lit(W1).alias("window_start"),
        F.lit(W1 + STEP).alias("window_end"),
        F.format_string("c%03d", "id").alias("campaign_id"),
        (F.col("id") if clicks is None else clicks).alias("clicks"),
        F.lit(1).alias("unique_users"),
        F.lit(None).cast("double").alias("ctr"),
    )


def test_a_batch_of_many_tasks(spark, upsert):
    upsert.write(_rows(spark, 100).repartition(6))
    found = _read(upsert)
    assert [(c, n) for c, n, _ in found] == [(f"c{i:03d}", i) for i in range(100)]
    assert {start for _, _, start in found} == {"2025-10-04 10:00:00+00:00"}
    assert _read(upsert, "campaign_agg_staging") == []


def test_sent_again_changes_nothing_and_later_values_win(spark, upsert):
    rows = _rows(spark, 20).repartition(3)
    upsert.write(rows)
    before = _read(upsert)
    upsert.write(rows)
    assert _read(upsert) == before
    upsert.write(_rows(spark, 5, F.col("id") * 10 + 1))
    assert [n for _, n, _ in _read(upsert)][:6] == [1, 11, 21, 31, 41, 5]


def test_a_task_that_fails_leaves_no_row_of_the_batch(spark, upsert):
    upsert.write(_rows(spark, 3))
    before = _read(upsert)
    broken = F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id") + 100)
    with pytest.raises(Exception, match="lost"):
        upsert.write(_rows(spark, 90, broken).repartition(8, "campaign_id"))
    assert _read(upsert) == before
    assert _read(upsert, "campaign_agg_staging") == []


def test_an_attempt_that_does_not_count(spark, upsert):
    """A task that was run twice has staged its rows twice; its commit message names one attempt."""
    writer = StagedWriter(upsert.upsert, "batch")
    row = (int(W1.timestamp() * 10**6), int((W1 + STEP).timestamp() * 10**6), "x", 5, 3, None)
    writer.write(iter([row]))
    counted = writer.write(iter([row, (*row[:2], "y", 6, 1, None)]))
    empty = writer.write(iter([]))
    assert len(_read(upsert, "campaign_agg_staging")) == 3 and empty.rows == 0
    writer.commit([counted, empty])
    assert [(c, n) for c, n, _ in _read(upsert)] == [("x", 5), ("y", 6)]
    assert _read(upsert, "campaign_agg_staging") == []


def test_a_commit_that_fails_moves_nothing(spark, upsert):
    writer = StagedWriter(upsert.upsert, "batch")
    times = (int(W1.timestamp() * 10**6), int((W1 + STEP).timestamp() * 10**6))
    good = writer.write(iter([(*times, "x", 5, 3, None)]))
    bad = writer.write(iter([(*times, None, 5, 3, None)]))
    with pytest.raises(sqlite3.IntegrityError):
        writer.commit([good, bad])
    assert _read(upsert) == []
    writer.abort([good, bad])
    assert _read(upsert, "campaign_agg_staging") == []


def test_as_a_sink(spark, upsert):
    sink = database_sink(upsert)
    sink(agg_rows(spark, [(W1, W1 + STEP, "x", 5, 3)]), 0)
    sink(agg_rows(spark, [(W1, W1 + STEP, "x", 8, 3)]), 1)
    sink(agg_rows(spark, []), 2)
    assert [(c, n) for c, n, _ in _read(upsert)] == [("x", 8)]
