"""Kept totals, reconciling back-fills and views that outlive folds."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from clicktide.operators.table import CampaignTable, Versions
from clicktide.plans.backfill import differences, reconcile
from clicktide.plans.serving import campaign_totals
from clicktide.plans.totals import CampaignTotals
from clicktide.streaming.refresh import ServingRefresh
from helpers import agg_rows, at, plan, tuples

W1 = at("10:00:00")
STEP = timedelta(seconds=10)
DAY = timedelta(days=1)


@pytest.fixture()
def table(tmp_path):
    return CampaignTable(str(tmp_path / "agg"))


def _rows(spark, *rows):
    return agg_rows(spark, [(start, start + STEP, c, n, u) for start, c, n, u in rows])


def _same(spark, table, totals):
    assert tuples(totals.read(spark)) == tuples(campaign_totals(table.latest(spark)))


def test_totals_follow_any_order_of_writes(spark, table):
    """Random writes, some done late or never, with folds and vacuums, against the full sum."""
    chance = random.Random(3)
    totals, open_writes = CampaignTotals(table), []
    for step in range(14):
        rows = {}
        for _ in range(4):
            key = W1 + STEP * chance.randrange(3) + DAY * chance.randrange(3), chance.choice("xyz")
            rows[key] = chance.randrange(50), chance.randrange(9)
        frame = _rows(spark, *[(*key, *value) for key, value in rows.items()])
        kind = chance.random()
        if kind < 0.3:
            open_writes.append((table.claim(spark), frame))
        else:
            table.upsert(frame, files=1)
        if open_writes and kind > 0.7:
            number, late = open_writes.pop(chance.randrange(len(open_writes)))
            table.write_claimed(late, number)
        if chance.random() < 0.6:
            totals.refresh(spark)
            _same(spark, table, totals)
        if step % 4 == 3:
            totals.compact(spark)
            table.vacuum(spark, retention_seconds=0)
            _same(spark, table, totals)
    totals.refresh(spark)
    _same(spark, table, totals)


def test_a_fold_without_the_totals(spark, table):
    """Folded before the totals had seen the writes: they add up anew."""
    totals = CampaignTotals(table)
    table.upsert(_rows(spark, (W1, "x", 5, 3)))
    totals.refresh(spark)
    table.upsert(_rows(spark, (W1, "x", 8, 3), (W1, "y", 1, 1)))
    table.upsert(_rows(spark, (W1, "x", 2, 1)))
    table.compact(spark)
    assert totals.refresh(spark) is True
    _same(spark, table, totals)
    assert totals.refresh(spark) is False


def test_a_refresh_reads_no_older_date(spark, table):
    totals = CampaignTotals(table)
    table.upsert(_rows(spark, *[(W1 - DAY * i, "x", i, i) for i in range(5)]))
    totals.refresh(spark)
    table.upsert(_rows(spark, (W1, "x", 9, 9), (W1, "y", 2, 1)))
    changes = totals.changes(spark)
    assert tuples(changes) == [("x", 9, 9), ("y", 2, 1)]
    text = plan(changes)
    # Each scan is bound to the new write's date.
    scans = [line for line in text.splitlines() if "FileScan parquet" in line]
    assert scans and all("(window_date" in line and "= 2025-10-04)" in line for line in scans)


def test_empty_tables_and_empty_writes(spark, table):
    totals = CampaignTotals(table)
    assert totals.read(spark).count() == 0
    totals.refresh(spark)
    assert totals.read(spark).count() == 0
    table.upsert(_rows(spark, (W1, "x", 5, 3)))
    table.upsert(_rows(spark).where("false"))
    assert totals.refresh(spark) and tuples(totals.read(spark)) == [("x", 5, 3)]
    table.upsert(_rows(spark).where("false"))
    assert totals.refresh(spark) and not totals.refresh(spark)
    assert tuples(totals.read(spark)) == [("x", 5, 3)] and totals.held(spark) == Versions(2)


def test_views_outlive_folds(spark, table):
    now = [0.0]
    refresh = ServingRefresh(spark, table, "v_", clock=lambda: now[0])
    for clicks in range(3):
        table.upsert(_rows(spark, (W1, "x", clicks, 1)))
        now[0] += 10
        refresh()
    # No batch for a long time; a fold and its vacuum take the files that the views name.
    now[0] += 601
    CampaignTotals(table).compact(spark)
    assert refresh.by_clock() is True and refresh.by_clock() is False
    table.vacuum(spark, retention_seconds=0)
    assert spark.table("v_campaign_agg").first().clicks == 2
    assert spark.table("v_latest_campaign_window").first().clicks == 2
    assert spark.table("v_campaign_totals").first().clicks == 2


# --- reconciling back-fill -------------------------------------------------------------------


def test_differences_tell_null_from_zero(spark):
    stored = _rows(spark, (W1, "a", 1, 1), (W1, "b", 2, 2), (W1, "c", 3, 3)).withColumn(
        "ctr", F.when(F.col("campaign_id") == "c", 0.0)
    )
    new = _rows(spark, (W1, "a", 1, 1), (W1, "b", 2, 1), (W1, "c", 3, 3), (W1, "d", 0, 0))
    found = {r.campaign_id: r.state for r in differences(new, stored).collect()}
    assert found == {"a": "same", "b": "changed", "c": "changed", "d": "inserted"}


def test_reconcile_writes_only_what_differs(spark, table):
    table.upsert(_rows(spark, (W1 - DAY, "x", 7, 7), (W1, "x", 5, 3), (W1, "y", 4, 1)))
    new = _rows(spark, (W1, "x", 5, 3), (W1, "y", 6, 2), (W1 + STEP, "x", 0, 0))
    found = reconcile(table, new, since=W1)
    assert sorted(r.state for r in found.collect()) == ["changed", "inserted", "same"]
    assert table.changelog(spark).where("version = 1").count() == 2
    assert reconcile(table, new, since=W1).where("state <> 'same'").count() == 0
    assert table.done(spark) == [0, 1]
    assert table.latest(spark).agg(F.sum("clicks")).first()[0] == 18


def test_a_backfill_that_failed_is_run_again(spark, table):
    new = _rows(spark, (W1, "x", 5, 3), (W1, "y", 6, 2))
    # Lost after half of its files, and never tried again under that number.
    lost = table.claim(spark)
    table._write(new.where("campaign_id = 'x'"), f"{table.root}/version={lost}", ["window_date"], None)
    assert table.latest(spark).count() == 0
    reconcile(table, new)
    assert tuples(table.latest(spark).select("campaign_id", "clicks")) == [("x", 5), ("y", 6)]
    reconcile(table, new.withColumn("clicks", F.col("clicks") + 1))
    table.compact(spark)
    assert table.unfolded(spark) == []
