"""Publishing events as JSON messages, and replaying a stored history as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clicktide.functions.codec import AGGREGATE_FIELDS, decode_events, encode_events
from clicktide.functions.store import Store
from clicktide.sources.events import landed_stream
from clicktide.sources.settings import KafkaSettings
from clicktide.streaming.runner import BatchSink, StreamSettings, finish, start_campaign_stream


# The date of the first landed file, in seconds since 1970.
FIRST_FILE = 1_000_000_000


def publish_to_topic(events: DataFrame, settings: KafkaSettings) -> None:
    """Send a batch of events to the topic. Needs Spark's Kafka connector."""
    encode_events(events).write.format("kafka").options(**settings.sink_options()).save()


def publish_to_files(events: DataFrame, path: str, mode: str = "append") -> None:
    """Write a batch of events as JSON lines, in a folder for each date and hour."""
    time = F.col("event_time").cast("timestamp")
    kept = events.select(
        "*", F.to_date(time).alias("event_date"), F.hour(time).alias("event_hour")
    )
    lines = encode_events(kept, carry=["event_date", "event_hour"])
    by_hour = lines.hint("rebalance", "event_date", "event_hour")
    by_hour.write.mode(mode).partitionBy("event_date", "event_hour").text(path)


def land_in_order(
    events: DataFrame,
    folder: str,
    files: int,
    order: str = "event_time",
    write: Callable[[DataFrame, str], None] | None = None,
) -> None:
    """Land a history in ``files`` files of about the same size that follow each other in time.

    One pass: a range partitioning by ``order`` gives every file a stretch of time, and the files are
    dated in that order, which is how a stream takes them. (The store must let files be dated.) Done
    once: a replay that is started again lands nothing twice. Rows without a time are not landed.
    """
    spark = events.sparkSession
    store = Store(spark, folder)
    if store.paths("_landed"):
        return
    rows = events.where(F.col(order).isNotNull()).repartitionByRange(files, order)
    (write or _write_lines)(rows, folder)
    # A task's number is in the names of its files, so names are in the order of ranges.
    for place, name in enumerate(store.paths("part-*")):
        store.set_seconds(name, FIRST_FILE + place)
    store.create("_landed")


def _write_lines(rows: DataFrame, folder: str) -> None:
    encode_events(rows).write.mode("overwrite").text(folder)


def _landed_events(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    raw = landed_stream(spark, path, files_per_batch)
    return decode_events(raw, fields=AGGREGATE_FIELDS)


def replay(
    events: DataFrame,
    landing: str,
    sink: BatchSink,
    settings: StreamSettings,
    batches: int,
    files_per_batch: int = 1,
    timeout: float | None = None,
    order: str = "event_time",
    write: Callable[[DataFrame, str], None] | None = None,
    read: Callable[[SparkSession, str, int], DataFrame] | None = None,
) -> StreamingQuery:
    """Land a history in the order of time and let one stream work through it in batches.

    A batch takes the next ``files_per_batch`` files, so it holds a stretch of time that follows the
    one before, and the watermark drops nothing. Files of a batch are read side by side: choose as
    many as there are cores, and so many batches that one is of a good size. ``write`` and ``read``
    say how events are kept, by default as JSON lines. Returns the finished query.
    """
    land_in_order(events, landing, batches * files_per_batch, order, write)
    stream = (read or _landed_events)(events.sparkSession, landing, files_per_batch)
    query = start_campaign_stream(stream, sink, settings)
    finish(query, timeout)
    return query
