"""Starting the campaign stream and sending its batches to a sink."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from clicktide.functions.codec import decode_rejects
from clicktide.operators.database import DatabaseUpsert
from clicktide.operators.staged import StagedUpsert
from clicktide.operators.table import CampaignTable
from clicktide.operators.windows import USERS_RSD, WINDOW_WIDTH, campaign_windows
from clicktide.session import ROCKSDB, session_options

# Allowed lateness and time between micro-batches.
WATERMARK = "30 seconds"
TRIGGER = "5 seconds"

BatchSink = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class StreamSettings:
    """``checkpoint`` must be on storage that outlives the driver.

    ``state_partitions`` is frozen into the checkpoint at the first start. ``trigger=None`` works
    through what is there and stops. ``large_state`` keeps state on disk (RocksDB).
    """

    checkpoint: str
    width: str = WINDOW_WIDTH
    watermark: str = WATERMARK
    rsd: float = USERS_RSD
    trigger: str | None = TRIGGER
    state_partitions: int | None = None
    large_state: bool = False


def _triggered(writer: DataStreamWriter, settings: StreamSettings) -> DataStreamWriter:
    writer = writer.option("checkpointLocation", settings.checkpoint)
    if settings.trigger is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=settings.trigger)


def windowed_stream(events: DataFrame, settings: StreamSettings) -> DataFrame:
    """The aggregate with state bounded by the watermark."""
    bounded = events.withWatermark("event_time", settings.watermark)
    return campaign_windows(bounded, settings.width, "approx", settings.rsd)


def start_campaign_stream(
    events: DataFrame, sink: BatchSink, settings: StreamSettings
) -> StreamingQuery:
    """Start the stream in update mode: each batch brings full totals of the keys it changed."""
    partitions = settings.state_partitions
    options = {
        "spark.sql.shuffle.partitions": str(partitions) if partitions else None,
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB if settings.large_state else None,
    }
    writer = windowed_stream(events, settings).writeStream.outputMode("update").foreachBatch(sink)
    with session_options(events.sparkSession, options):
        return _triggered(writer, settings).start()


def start_rejects_stream(raw: DataFrame, path: str, settings: StreamSettings) -> StreamingQuery:
    """Append messages that cannot be decoded, with the reason, to Parquet files."""
    return start_append_stream(decode_rejects(raw), path, settings)


def start_append_stream(rows: DataFrame, path: str, settings: StreamSettings) -> StreamingQuery:
    """Append a stream's rows to Parquet files, each once."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path)
    return _triggered(writer, settings).start()


def finish(query: StreamingQuery, timeout: float | None = None) -> None:
    """Wait for an available-now query; stop it and raise when it takes longer than ``timeout``."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream not done after {timeout} s")


def finish_all(
    queries: list[StreamingQuery], idle: Callable[[], object] | None = None
) -> None:
    """Wait for streams that belong together; when one fails, stop the others and raise.

    ``idle`` is called about once a second meanwhile.
    """
    try:
        while any(query.isActive for query in queries):
            for query in queries:
                query.awaitTermination(1)
            if idle:
                idle()
        for query in queries:
            query.awaitTermination()
    finally:
        for query in queries:
            query.stop()


def table_sink(
    table: CampaignTable, files: int | None = None, then: BatchSink | None = None
) -> BatchSink:
    """Sink into the file table; ``files`` as in ``CampaignTable.upsert``.

    A batch that is sent again writes the same totals once more.

    Streams run without AQE. The batch's aggregate is done when it gets here, so AQE is switched on
    for what the sink does with it: few files for a usual batch, many tasks for a large backlog.

    ``then`` runs after each batch, for example a serving refresh. Folding the table isn't part of
    a batch: ``CampaignTable.compact`` may run beside the stream.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with session_options(spark, {"spark.sql.adaptive.enabled": "true"}):
            table.upsert(batch, files)
            if then:
                then(batch, batch_id)

    return write


def database_sink(database: DatabaseUpsert | StagedUpsert) -> BatchSink:
    """Sink into a relational database; the keyed upsert makes a repeated batch harmless.

    ``StagedUpsert`` shows readers all rows of a batch at once, ``DatabaseUpsert`` those of a task.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        database.write(batch)

    return write
