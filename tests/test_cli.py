from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

import __spark_entry__ as driver
from clicktide.__main__ import main
from clicktide.contracts import CAMPAIGN_AGG_SCHEMA
from clicktide.operators.table import CampaignTable
from helpers import message


def _now_messages(seconds_ago):
    now = datetime.now(timezone.utc)
    for ago in seconds_ago:
        time = (now - timedelta(seconds=ago)).isoformat(timespec="milliseconds")
        yield message("00:00:00", event_time=time)


def test_stream_report_backfill_compact(spark, tmp_path, capsys):
    events, table = tmp_path / "events", str(tmp_path / "agg")
    events.mkdir()
    (events / "a.txt").write_text("\n".join(_now_messages([60, 61, 300])) + "\ngarbage\n")

    main(["--master", "local[4]", "report", "--table", table])
    assert "No data yet." in capsys.readouterr().out

    checkpoint = str(tmp_path / "checkpoint")
    main(["stream", "--events", str(events), "--table", table, "--checkpoint", checkpoint,
          "--drain", "--state-partitions", "2", "--rejects", str(tmp_path / "rejects"),
          "--views", "cli_", "--accounts", str(tmp_path / "books")])
    stored = spark.read.parquet(str(tmp_path / "rejects"))
    assert [r.reason for r in stored.collect()] == ["not_an_event"]
    assert CampaignTable(table).latest(spark).agg(F.sum("clicks")).first()[0] == 3

    main(["accounts", "--table", table, "--accounts", str(tmp_path / "books")])
    assert "messages: 4\nrejected: 1\nlate: 0\nkept: 3\n" in capsys.readouterr().out

    main(["report", "--table", table, "--minutes", "30"])
    assert "latest_unique_users" in capsys.readouterr().out

    main(["backfill", "--events", str(events), "--table", table, "--windows", "12"])
    rows = CampaignTable(table).latest(spark)
    assert rows.agg(F.sum("clicks")).first()[0] == 3
    assert rows.where("clicks = 0").count() >= 10

    main(["compact", "--table", table])
    assert rows.count() == CampaignTable(table).latest(spark).count()


def test_entry_returns_the_flagship_query(spark):
    result = driver.entry(spark)
    assert result.columns == [
        "window_start", "window_end", "campaign_id", "clicks", "unique_users", "ctr",
    ]
    assert result.count() > 0


def test_report_reads_the_database_with_several_readers(spark, monkeypatch):
    """What is asked of the database's reader; no database is reached."""
    asked = {}

    def read(session, options, lower, upper, readers):
        asked.update(readers=readers, minutes=(upper - lower).total_seconds() / 60)
        return session.createDataFrame([], CAMPAIGN_AGG_SCHEMA)

    monkeypatch.setattr("clicktide.__main__.read_database", read)
    monkeypatch.setenv("JDBC_URL", "jdbc:postgresql://none/none")
    monkeypatch.setenv("DB_USER", "nobody")
    main(["report", "--minutes", "30", "--readers", "6"])
    assert asked == {"readers": 6, "minutes": 30.0}
