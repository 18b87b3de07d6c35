"""Command line: run the stream, publish or back-fill events, compact the table, show the report."""

from __future__ import annotations

import argparse
from contextlib import nullcontext
from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession

from clicktide.functions.codec import AGGREGATE_FIELDS, decode_events
from clicktide.functions.times import micros
from clicktide.operators.database import postgres_upsert
from clicktide.operators.staged import StagedUpsert
from clicktide.operators.table import CampaignTable
from clicktide.operators.windows import WINDOW_WIDTH
from clicktide.plans import serving
from clicktide.plans.backfill import backfill, reconcile
from clicktide.plans.totals import CampaignTotals
from clicktide.session import build_session, materialize
from clicktide.sources.aggregates import read_database
from clicktide.sources.events import kafka_stream, landed_batch, landed_stream, throttle
from clicktide.sources.settings import (
    KafkaSettings,
    backfill_windows,
    database_url,
    jdbc_options,
)
from clicktide.streaming.accounts import RowAccounts, observed, row_accounts
from clicktide.streaming.refresh import ServingRefresh
from clicktide.streaming.replay import publish_to_topic
from clicktide.streaming.runner import (
    TRIGGER,
    WATERMARK,
    StreamSettings,
    database_sink,
    finish_all,
    start_campaign_stream,
    start_rejects_stream,
    table_sink,
)


def _stream(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.events:
        if args.rate:
            raise SystemExit("--rate is for the topic; use --max-files or --max-bytes with --events")
        raw = landed_stream(spark, args.events, args.max_files, args.max_bytes)
    else:
        settings = KafkaSettings.from_env()
        if args.rate:
            limit = throttle(args.rate, args.trigger)
            settings = replace(settings, max_offsets_per_trigger=limit)
        raw = kafka_stream(spark, settings)
    refresh = None
    if args.table:
        table = CampaignTable(args.table)
        refresh = ServingRefresh(spark, table, args.views) if args.views is not None else None
        sink = table_sink(table, then=refresh)
    else:
        database = StagedUpsert(postgres_upsert(database_url(), max_connections=args.max_connections))
        database.ensure_table()
        sink = database_sink(database)
    settings = StreamSettings(
        args.checkpoint,
        watermark=args.watermark,
        trigger=None if args.drain else args.trigger,
        state_partitions=args.state_partitions,
        large_state=args.large_state,
    )
    started = []
    if args.rejects:
        own = replace(settings, checkpoint=f"{args.checkpoint}-rejects")
        started.append(start_rejects_stream(raw, args.rejects, own))
    watch = observed if args.accounts else None
    events = decode_events(raw, fields=AGGREGATE_FIELDS, watch=watch)
    with RowAccounts(spark, args.accounts) if args.accounts else nullcontext() as accounts:
        query = start_campaign_stream(events, sink, settings)
        started.append(accounts.follow(query) if accounts else query)
        finish_all(started, refresh and refresh.by_clock)


def _publish(spark: SparkSession, args: argparse.Namespace) -> None:
    events = decode_events(landed_batch(spark, args.events), keep_null_campaign=True)
    publish_to_topic(events, KafkaSettings.from_env())


def _backfill(spark: SparkSession, args: argparse.Namespace) -> None:
    windows, as_of = args.windows or backfill_windows(), datetime.now(timezone.utc)
    since = as_of - timedelta(microseconds=micros(args.width) * (windows + 1))
    landed = landed_batch(spark, args.events, since)
    # The few windows' events are looked at twice, for their campaigns and their counts.
    events = materialize(decode_events(landed, fields=AGGREGATE_FIELDS), "events")
    table = CampaignTable(args.table) if args.table else None
    names = None
    if args.campaigns:
        rows = [(name,) for name in args.campaigns.split(",")]
        names = spark.createDataFrame(rows, "campaign_id string")
    elif table:
        # The kept totals have every campaign there ever was.
        totals = CampaignTotals(table)
        totals.refresh(spark)
        names = totals.read(spark).select("campaign_id").unionByName(events.select("campaign_id"))
    rows = backfill(events, names, windows, args.width, as_of)
    if table:
        states = reconcile(table, rows, since).groupBy("state").count().collect()
        print(*sorted(f"{row['state']}: {row['count']}" for row in states), sep="\n")
    else:
        database = StagedUpsert(postgres_upsert(database_url(), max_connections=args.max_connections))
        database.ensure_table()
        database.write(rows)


def _report(spark: SparkSession, args: argparse.Namespace) -> None:
    """All parts of one moment, from one read of the slice."""
    as_of, ago = datetime.now(timezone.utc), serving.horizon(args.minutes)
    if args.table:
        rows = serving.stored_trailing_windows(spark, CampaignTable(args.table), ago, as_of)
    else:
        # Readers share the slice's time between them; the filter itself is the database's.
        first = as_of - timedelta(minutes=args.minutes)
        stored = read_database(spark, jdbc_options(), first, as_of, args.readers)
        rows = serving.trailing_windows(stored, ago, as_of)
    rows = materialize(rows, "report")
    if rows.isEmpty():
        print("No data yet.")
        return
    for part in (
        serving.dashboard_kpis(rows),
        serving.clicks_by_campaign(rows),
        serving.latest_window_ranked(rows),
    ):
        print(*part.columns, sep="\t")
        for row in part.toLocalIterator():
            print(*row, sep="\t")
        print()


def _accounts(spark: SparkSession, args: argparse.Namespace) -> None:
    row = row_accounts(spark, args.accounts, CampaignTable(args.table)).first()
    print(*[f"{name}: {count}" for name, count in row.asDict().items()], sep="\n")


def _compact(spark: SparkSession, args: argparse.Namespace) -> None:
    table = CampaignTable(args.table)
    CampaignTotals(table).compact(spark)
    if args.vacuum:
        table.vacuum(spark)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="clicktide", description=__doc__)
    top.add_argument("--master", help="Spark master; left to spark-submit when not given")
    commands = top.add_subparsers(dest="command", required=True)

    stream = commands.add_parser("stream", help="aggregate the topic, or landed files")
    stream.add_argument("--events", help="folder of JSON lines; the topic when not given")
    stream.add_argument("--table", help="folder of the file table; the database when not given")
    stream.add_argument("--checkpoint", required=True)
    stream.add_argument("--rejects", help="folder for messages that cannot be decoded")
    stream.add_argument("--watermark", default=WATERMARK)
    stream.add_argument("--trigger", default=TRIGGER)
    stream.add_argument("--drain", action="store_true", help="stop when all input is taken")
    stream.add_argument("--rate", type=float, help="events per second to take from the topic")
    stream.add_argument("--max-files", type=int, help="files per micro-batch")
    stream.add_argument("--max-bytes", type=int, help="bytes of files per micro-batch")
    stream.add_argument("--state-partitions", type=int)
    stream.add_argument("--views", help="keep serving views with this prefix up to date")
    stream.add_argument("--accounts", help="folder for what becomes of each batch's messages")
    stream.add_argument("--large-state", action="store_true", help="keep state in RocksDB")
    stream.set_defaults(run=_stream)

    publish = commands.add_parser("publish", help="send landed events to the topic")
    publish.add_argument("--events", required=True)
    publish.set_defaults(run=_publish)

    fill = commands.add_parser("backfill", help="recompute the last windows from landed events")
    fill.add_argument("--events", required=True)
    fill.add_argument("--table", help="folder of the file table; the database when not given")
    fill.add_argument("--windows", type=int)
    fill.add_argument("--width", default=WINDOW_WIDTH)
    fill.add_argument("--campaigns", help="names, with commas; else those of table and events")
    fill.set_defaults(run=_backfill)

    report = commands.add_parser("report", help="show KPIs, clicks over time, newest window")
    report.add_argument("--table", help="folder of the file table; the database when not given")
    report.add_argument("--minutes", type=int, default=serving.HORIZON_DEFAULT)
    report.add_argument("--readers", type=int, default=4, help="connections that read the database")
    report.set_defaults(run=_report)

    books = commands.add_parser("accounts", help="messages kept, late and rejected so far")
    books.add_argument("--table", required=True, help="folder of the table that the stream writes")
    books.add_argument("--accounts", required=True, help="folder of the stream's accounts")
    books.set_defaults(run=_accounts)

    compact = commands.add_parser("compact", help="fold the changelog into one version per date")
    compact.add_argument("--table", required=True)
    compact.add_argument("--vacuum", action="store_true", help="delete what was folded an hour ago")
    compact.set_defaults(run=_compact)

    for command in (stream, fill):
        command.add_argument("--max-connections", type=int)
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    args.run(build_session(master=args.master), args)


if __name__ == "__main__":
    main()
