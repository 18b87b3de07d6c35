"""The registered queries: every operator run over the whole ``events`` table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktide.contracts import AGG_KEYS
from clicktide.functions.codec import (
    AGGREGATE_FIELDS,
    decode_events,
    decode_rejects,
    encode_events,
)
from clicktide.functions.store import Store
from clicktide.functions.times import align_to_window, moment_before
from clicktide.operators.checks import contract_violations
from clicktide.operators.grid import window_grid
from clicktide.operators.table import CampaignTable
from clicktide.operators.windows import (
    campaign_windows,
    latest_window_end,
    merged_sketches,
    user_sketches,
    users_of,
)
from clicktide.plans import serving
from clicktide.plans.backfill import backfill, reconcile
from clicktide.plans.totals import CampaignTotals
from clicktide.session import ROCKSDB, fresh_folder, materialize, session_options, use_utc
from clicktide.sources.events import (
    as_events,
    event_batch,
    event_table,
    event_table_stream,
    landed_stream,
)
from clicktide.streaming.accounts import RowAccounts, observed, row_accounts
from clicktide.streaming.refresh import ServingRefresh
from clicktide.streaming.replay import FIRST_FILE, replay
from clicktide.streaming.runner import (
    BatchSink,
    StreamSettings,
    finish,
    start_campaign_stream,
    start_rejects_stream,
    table_sink,
)
from clicktide.streaming.state import windows_in_state

Query = Callable[[SparkSession, str], DataFrame]

# The test table is sparse, so the serving queries use one-hour windows and a one-day horizon.
SERVING_WIDTH = "1 hour"
SERVING_HORIZON = "24 hours"
GRID_WINDOWS = 12
# The stream's own width, with the longest horizon of the dashboard.
STREAM_WIDTH = "10 seconds"
STREAM_HORIZON = serving.horizon(serving.HORIZON_MAX)
CAMPAIGNS = ("cmp-001", "cmp-002", "cmp-003", "cmp-004")
REPLAY_BATCHES = 5
BATCH_ROWS = 1_000_000
STATE_PARTITIONS = 4
# Wide enough that the stream's end leaves windows open.
STATE_WIDTH = "1 hour"

# Where the history is cut into three writes; both cuts lie inside a one-hour window.
UPSERT_CUTS = (datetime(2024, 1, 10, 12, 30), datetime(2024, 1, 20, 12, 30))

_registered: dict[str, Query] = {}


def _query(function: Query) -> Query:
    """Register a function under its name, without the underscore that keeps it from an import."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(use_utc(spark), sf_dir)

    _registered[function.__name__.removeprefix("_")] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_registered)


def _without_zone(df: DataFrame) -> DataFrame:
    """Times as the test table has them, without a zone."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz") if f.dataType.typeName() == "timestamp" else f.name
            for f in df.schema
        ]
    )


def _exact(spark: SparkSession, sf_dir: str, width: str = SERVING_WIDTH) -> DataFrame:
    return campaign_windows(event_batch(spark, sf_dir), width, "exact")


def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_batch(spark, sf_dir)
    return serving.trailing_from_events(events, SERVING_WIDTH, SERVING_HORIZON, users="exact")


# --- windowed aggregates ---------------------------------------------------------------------


@_query
def campaign_windows_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir, STREAM_WIDTH)


@_query
def campaign_windows_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir, "1 day")


def _users_check(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: whether clicks are equal and the approximate users as good as they should be.

    At any size about one key in four hundred is outside three standard errors. So the check is
    that at most one in a hundred is, that errors even out, and that none is beyond eight.
    """
    keys = [F.col(key) for key in AGG_KEYS]
    counted = exact.select(
        *keys, F.col("unique_users").alias("exact_users"), F.col("clicks").alias("exact_clicks")
    )
    joined = approximate.join(counted, list(AGG_KEYS), "full")
    off = F.col("unique_users") - F.col("exact_users")
    error = F.when(F.abs(off) <= 1, F.lit(0.0)).otherwise(off / F.col("exact_users"))
    return joined.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(
            F.sum(F.col("clicks").eqNullSafe(F.col("exact_clicks")).cast("int"))
            == F.count(F.lit(1)),
            F.lit(True),
        ).alias("clicks_equal"),
        F.coalesce(F.avg((F.abs(error) > 0.15).cast("int")) <= 0.01, F.lit(True)).alias("few_off"),
        F.coalesce(F.abs(F.avg(error)) <= 0.02, F.lit(True)).alias("unbiased"),
        F.coalesce(F.max(F.abs(error)) <= 0.4, F.lit(True)).alias("bounded"),
    )


@_query
def campaign_windows_approx_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    approximate = campaign_windows(event_batch(spark, sf_dir), SERVING_WIDTH, "approx")
    return _users_check(approximate, _exact(spark, sf_dir))


@_query
def campaign_users_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users per campaign over all windows, merged from kept sketches; close to the exact number.

    Windows are merged by day first and days then, as a reader of kept sketches would.
    """
    events = event_batch(spark, sf_dir)
    kept = materialize(user_sketches(events, SERVING_WIDTH), "user-sketches")
    by_day = kept.withColumn("day", F.to_date("window_start"))
    merged = merged_sketches(merged_sketches(by_day, "day", "campaign_id"), "campaign_id")
    exact = events.where("event_time is not null").groupBy("campaign_id").agg(
        F.count_distinct("user_id").alias("exact_users")
    )
    off = F.abs(F.col("users") - F.col("exact_users"))
    close = (off <= F.greatest(F.lit(1), F.ceil(F.col("exact_users") * 0.06))).alias("users_close")
    return users_of(merged).join(exact, "campaign_id").select("campaign_id", "exact_users", close)


@_query
def _align_to_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_batch(spark, sf_dir, carry=["event_id"]).select("event_id", "event_time")
    return align_to_window(events, "event_time", STREAM_WIDTH)


# --- serving, from the stored table ------------------------------------------------------------


_stored_tables: dict[tuple[str, str], CampaignTable] = {}


def _stored(spark: SparkSession, sf_dir: str) -> CampaignTable:
    """The table with the aggregate of all events, written once in an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stored_tables:
        table = CampaignTable(fresh_folder(spark, "campaign-agg"))
        table.upsert(_exact(spark, sf_dir))
        _stored_tables[key] = table
    return _stored_tables[key]


def _stored_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _stored(spark, sf_dir)
    return serving.stored_trailing_windows(spark, table, SERVING_HORIZON, table.newest_end(spark))


@_query
def campaign_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.campaign_totals(_stored(spark, sf_dir).latest(spark))


@_query
def latest_campaign_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_zone(serving.stored_latest_window(spark, _stored(spark, sf_dir)))


@_query
def latest_campaign_window_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    serving.register_views(spark, _stored(spark, sf_dir), "clicktide_")
    return _without_zone(spark.table("clicktide_latest_campaign_window"))


@_query
def campaign_totals_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    serving.register_views(spark, _stored(spark, sf_dir), "clicktide_")
    return spark.table("clicktide_campaign_totals")


@_query
def trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_zone(_stored_trailing(spark, sf_dir))


@_query
def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.dashboard_kpis(_stored_trailing(spark, sf_dir))


@_query
def clicks_over_time_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _stored_trailing(spark, sf_dir)
    return _without_zone(serving.clicks_over_time(frame, CAMPAIGNS))


@_query
def clicks_over_time_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivot with the names that the frame has."""
    return _without_zone(serving.clicks_over_time(_stored_trailing(spark, sf_dir)))


@_query
def clicks_by_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_zone(serving.clicks_by_campaign(_stored_trailing(spark, sf_dir)))


@_query
def latest_window_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_zone(serving.latest_window_ranked(_stored_trailing(spark, sf_dir)))


# --- serving, from raw events ------------------------------------------------------------------


@_query
def latest_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.latest_from_events(event_batch(spark, sf_dir), SERVING_WIDTH, users="exact")


@_query
def trailing_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trailing(spark, sf_dir)


def _trailing_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_batch(spark, sf_dir)
    return serving.trailing_from_events(events, STREAM_WIDTH, STREAM_HORIZON, users="exact")


@_query
def campaign_totals_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.campaign_totals(_exact(spark, sf_dir, STREAM_WIDTH))


@_query
def latest_campaign_window_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.latest_from_events(event_batch(spark, sf_dir), STREAM_WIDTH, users="exact")


@_query
def trailing_window_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trailing_10s(spark, sf_dir)


@_query
def dashboard_kpis_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.dashboard_kpis(_trailing_10s(spark, sf_dir))


@_query
def clicks_over_time_pivot_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.clicks_over_time(_trailing_10s(spark, sf_dir), CAMPAIGNS)


# --- messages --------------------------------------------------------------------------------


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a message, with what goes wrong decided by its type."""
    events = as_events(event_table(spark, sf_dir), carry=["event_id", "event_type"])
    sent = encode_events(events, carry=["event_id", "event_type"])
    kind, text = F.col("event_type"), F.col("value")
    no_time = F.regexp_replace(text, r'"event_time":"[^"]*"', '"event_time":"some day"')
    no_campaign = F.regexp_replace(text, r'"campaign_id":"[^"]*",', "")
    broken = (
        F.when(kind == "error", F.concat(F.lit("not a message: "), text))
        .when(kind == "signup", no_time)
        .when(kind == "purchase", no_campaign)
        .otherwise(text)
    )
    return sent.select("event_id", broken.alias("value"))


@_query
def encode_events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_events(event_batch(spark, sf_dir, carry=["event_id"]), carry=["event_id"])


@_query
def encode_events_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = encode_events(event_batch(spark, sf_dir, carry=["event_id"]), carry=["event_id"])
    return _without_zone(decode_events(sent, carry=["event_id"]))


@_query
def _decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_zone(decode_events(_messages(spark, sf_dir), carry=["event_id"]))


@_query
def _decode_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = decode_rejects(_messages(spark, sf_dir), carry=["event_id"])
    return rejects.select("event_id", "reason")


# --- keyed table -----------------------------------------------------------------------------


def _written_in_parts(spark: SparkSession, sf_dir: str) -> CampaignTable:
    """The table after three writes, each with full totals of the windows it touches.

    A window that is cut in two is written first with half of its events, then with all of them.
    """
    table = CampaignTable(fresh_folder(spark, "campaign-agg"))
    events = event_batch(spark, sf_dir)
    cuts = [F.lit(cut.isoformat(sep=" ")).cast("timestamp_ntz") for cut in UPSERT_CUTS]
    time = F.col("event_time")
    for lower, upper in zip([None, *cuts], [*cuts, None]):
        part = events
        if lower is not None:
            part = part.where(time >= F.date_trunc("hour", lower).cast("timestamp_ntz"))
        if upper is not None:
            part = part.where(time < upper)
        table.upsert(campaign_windows(part, SERVING_WIDTH, "exact"))
    return table


@_query
def upsert_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_zone(_written_in_parts(spark, sf_dir).latest(spark))


@_query
def upsert_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each write; ``version`` is twice its number."""
    rows = _written_in_parts(spark, sf_dir).changelog(spark)
    version = (F.col("version") * 2).alias("version")
    return rows.groupBy(version).agg(F.count(F.lit(1)).alias("n_rows"))


@_query
def compacted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _written_in_parts(spark, sf_dir)
    table.compact(spark)
    table.vacuum(spark, retention_seconds=0)
    return _without_zone(table.changelog(spark).select(*AGG_KEYS, "clicks", "unique_users"))


@_query
def stored_trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_zone(_stored_trailing(spark, sf_dir))


@_query
def upsert_interleaved_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's batch, a back-fill and a newer batch of the stream, on the same keys.

    The stream first writes what it has seen of each window up to the first cut; the back-fill
    writes twice that of the windows up to the second cut; then the stream writes all of what comes
    after the first cut. Each key keeps its last write. Between the last two a fold runs beside a
    write that is under way.
    """
    table = CampaignTable(fresh_folder(spark, "campaign-agg"))
    rows = _exact(spark, sf_dir)
    first, second = [F.lit(cut.isoformat(sep=" ")).cast("timestamp_ntz") for cut in UPSERT_CUTS]
    table.upsert(rows.where(F.col("window_start") < first))
    doubled = rows.withColumn("clicks", F.col("clicks") * 2)
    table.upsert(doubled.where(F.col("window_start") < second))
    table.claim(spark)
    table.compact(spark)
    table.vacuum(spark, retention_seconds=0)
    table.upsert(rows.where(F.col("window_start") >= first))
    return _without_zone(table.latest(spark))


@_query
def campaign_totals_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals kept write by write while a stream and a back-fill write the same keys in turn.

    As in ``upsert_interleaved_writers``; the back-fill gets done after the stream's last write.
    """
    table = CampaignTable(fresh_folder(spark, "campaign-agg"))
    totals = CampaignTotals(table)
    rows = _exact(spark, sf_dir)
    first, second = [F.lit(cut.isoformat(sep=" ")).cast("timestamp_ntz") for cut in UPSERT_CUTS]
    table.upsert(rows.where(F.col("window_start") < first))
    totals.refresh(spark)
    doubled = rows.withColumn("clicks", F.col("clicks") * 2)
    late = table.claim(spark)
    table.upsert(rows.where(F.col("window_start") >= first))
    totals.compact(spark)
    table.write_claimed(doubled.where(F.col("window_start") < second), late)
    totals.refresh(spark)
    return totals.read(spark)


@_query
def agg_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each campaign's rows get a second, broken copy; which rule it breaks goes by campaign."""
    whole = F.struct("window_start", "window_end", "campaign_id", "clicks", "unique_users", "ctr")
    campaign = F.col("campaign_id")
    broken = (
        F.when(campaign == "cmp-001", whole.withField("campaign_id", F.lit(None).cast("string")))
        .when(campaign == "cmp-002", whole)
        .when(campaign == "cmp-003", whole.withField("window_end", F.col("window_start")))
        .otherwise(
            whole.withField("campaign_id", F.lit("cmp-negative")).withField(
                "clicks", -F.col("clicks")
            )
        )
    )
    rows = _exact(spark, sf_dir).select(F.explode(F.array(whole, broken)).alias("row"))
    return contract_violations(rows.select("row.*"))


# --- grid and back-fill ----------------------------------------------------------------------


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_batch(spark, sf_dir)
    newest = latest_window_end(events, SERVING_WIDTH)
    grid = window_grid(events, GRID_WINDOWS, SERVING_WIDTH, newest)
    return _without_zone(grid)


def _campaigns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in CAMPAIGNS], "campaign_id string")


def _backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_batch(spark, sf_dir)
    newest = latest_window_end(events, SERVING_WIDTH)
    names = _campaigns(spark)
    rows = backfill(events, names, GRID_WINDOWS, SERVING_WIDTH, newest, users="exact")
    return _without_zone(rows)


@_query
def _window_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@_query
def backfill_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backfill(spark, sf_dir).drop("ctr")


@_query
def backfill_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The back-fill written over a table that already has the history of the first days."""
    table = CampaignTable(fresh_folder(spark, "campaign-agg"))
    first = F.lit(UPSERT_CUTS[0].isoformat(sep=" ")).cast("timestamp_ntz")
    early = event_batch(spark, sf_dir).where(F.col("event_time") < first)
    table.upsert(campaign_windows(early, SERVING_WIDTH, "exact"))
    table.upsert(_backfill(spark, sf_dir))
    return _without_zone(table.latest(spark).drop("ctr"))


@_query
def backfill_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a back-fill of the last windows finds in a table that ends inside one of them.

    The table has the events up to six and a half hours before the end, and every campaign's oldest
    window of the back-fill twice. A second back-fill must find nothing to write.
    """
    table = CampaignTable(fresh_folder(spark, "campaign-agg"))
    events = event_batch(spark, sf_dir)
    newest = latest_window_end(events, SERVING_WIDTH)
    cut = moment_before(newest, "6 hours 30 minutes").cast("timestamp_ntz")
    table.upsert(campaign_windows(events.where(F.col("event_time") < cut), SERVING_WIDTH, "exact"))
    rows = _backfill(spark, sf_dir)
    oldest = rows.where(F.col("window_end") == rows.agg(F.min("window_end").alias("e")).scalar())
    table.upsert(oldest.withColumn("clicks", F.col("clicks") * 2 + 1))
    found = reconcile(table, rows)
    again = reconcile(table, rows)
    writes = F.lit(len(table.done(spark)) == 3 and again.where("state <> 'same'").isEmpty())
    counts = found.groupBy("state").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.select("state", "n_rows", writes.alias("second_writes_nothing"))


# --- streams ---------------------------------------------------------------------------------


def _stream_settings(spark: SparkSession, **more: object) -> StreamSettings:
    """Settings for working through a table, with state on disk."""
    return StreamSettings(
        fresh_folder(spark, "checkpoint"),
        trigger=None,
        state_partitions=STATE_PARTITIONS,
        large_state=True,
        **more,
    )


def _batches(events: DataFrame) -> int:
    """So many that a micro-batch takes about BATCH_ROWS rows, and several in any case."""
    return max(REPLAY_BATCHES, -(-events.count() // BATCH_ROWS))


def _replayed(
    spark: SparkSession,
    sf_dir: str,
    width: str,
    then: Callable[[CampaignTable], BatchSink] | None = None,
) -> CampaignTable:
    table = CampaignTable(fresh_folder(spark, "campaign-agg"))
    events = event_batch(spark, sf_dir)
    sink = table_sink(table, then=then and then(table))
    settings = _stream_settings(spark, width=width)
    replay(events, fresh_folder(spark, "landing"), sink, settings, _batches(event_table(spark, sf_dir)))
    return table


@_query
def upsert_stream_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table left by the replayed JSON stream, with 30 s of allowed lateness."""
    latest = _replayed(spark, sf_dir, STREAM_WIDTH).latest(spark)
    return _without_zone(latest.select(*AGG_KEYS, "clicks"))


@_query
def stream_campaign_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream of Parquet slices in time order; each key's clicks, and the check of all users."""
    table = CampaignTable(fresh_folder(spark, "campaign-agg"))
    stored = event_table(spark, sf_dir)
    replay(
        stored,
        fresh_folder(spark, "landing"),
        table_sink(table),
        _stream_settings(spark, width=STREAM_WIDTH),
        _batches(stored),
        order="ts",
        write=lambda rows, folder: rows.write.mode("overwrite").parquet(folder),
        read=event_table_stream,
    )
    rows = _without_zone(table.latest(spark))
    check = _users_check(rows, _exact(spark, sf_dir, STREAM_WIDTH))
    good = check.select((F.col("few_off") & F.col("unbiased") & F.col("bounded")).alias("good"))
    return rows.select(*AGG_KEYS, "clicks", good.scalar().alias("users_close"))


# Where the history is cut into deliveries; some rows come two deliveries late, some one.
DELIVERY_DAYS = 6
DELIVERIES = 7


def _delivered(spark: SparkSession, sf_dir: str) -> str:
    """A folder of messages, a file for each delivery, in the order of their dates."""
    own = event_table(spark, sf_dir).select(
        "event_id",
        F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01")) / DELIVERY_DAYS).alias("part"),
        F.when(F.col("user_id") % 10 == 0, 2).when(F.col("user_id") % 10 == 1, 1).otherwise(0).alias("by"),
    )
    sent = _messages(spark, sf_dir).join(own, "event_id")
    sent = sent.select("value", (F.col("part") + F.col("by")).alias("delivery"))
    folder = fresh_folder(spark, "landing")
    sent.repartition("delivery").write.partitionBy("delivery").text(folder)
    store = Store(spark, folder)
    for number in range(DELIVERIES):
        for path in store.paths(f"delivery={number}/part-*"):
            store.set_seconds(path, FIRST_FILE + number)
    return folder


@_query
def stream_row_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of messages of which some come too late and some can't be used."""
    table = CampaignTable(fresh_folder(spark, "campaign-agg"))
    raw = landed_stream(spark, _delivered(spark, sf_dir), max_files_per_trigger=1)
    events = decode_events(raw, fields=AGGREGATE_FIELDS, watch=observed)
    books = fresh_folder(spark, "accounts")
    with RowAccounts(spark, books) as accounts:
        settings = _stream_settings(spark, width=STREAM_WIDTH)
        finish(accounts.follow(start_campaign_stream(events, table_sink(table), settings)))
    return row_accounts(spark, books, table)


@_query
def stream_state_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and campaigns in the stream's state after the replay's last batch."""
    table = CampaignTable(fresh_folder(spark, "campaign-agg"))
    settings = _stream_settings(spark, width=STATE_WIDTH)
    batches = _batches(event_table(spark, sf_dir))
    replay(event_batch(spark, sf_dir), fresh_folder(spark, "landing"), table_sink(table), settings, batches)
    with session_options(spark, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
        return _without_zone(materialize(windows_in_state(spark, settings.checkpoint), "state"))


@_query
def stream_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing, rejects = fresh_folder(spark, "landing"), fresh_folder(spark, "rejects")
    _messages(spark, sf_dir).select("value").write.text(landing)
    finish(start_rejects_stream(landed_stream(spark, landing), rejects, _stream_settings(spark)))
    stored = spark.read.parquet(rejects)
    return stored.groupBy("reason").agg(F.count(F.lit(1)).alias("n_messages"))


@_query
def refreshed_serving_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals as the view shows them after the stream's last batch, and whether users are right."""
    table = _replayed(
        spark,
        sf_dir,
        SERVING_WIDTH,
        then=lambda table: ServingRefresh(spark, table, prefix="clicktide_", ttl=0),
    )
    stored = table.latest(spark).groupBy("campaign_id").agg(F.sum("unique_users").alias("stored"))
    shown = spark.table("clicktide_campaign_totals").join(stored, "campaign_id")
    same = (F.col("unique_users") == F.col("stored")).alias("users_as_stored")
    return shown.select("campaign_id", "clicks", same)
