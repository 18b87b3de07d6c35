"""What became of the messages of a stream: kept, late or rejected, batch by batch.

The stream observes how many messages a batch has and how many of them can't be used. A listener
writes one small file per batch, which a batch that is run again replaces by the same numbers. What
the watermark dropped is the rest: usable messages less the clicks in the table.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import (
    QueryProgressEvent,
    QueryStartedEvent,
    QueryTerminatedEvent,
)

from clicktide.functions.store import Store
from clicktide.operators.table import CampaignTable

ACCOUNTS_SCHEMA = "batch_id long, messages long, rejected long, groups_dropped long"
# The name under which the stream observes its messages.
OBSERVED = "messages"


def observed(parsed: DataFrame, usable) -> DataFrame:
    """The messages, counted as they pass by."""
    return parsed.observe(
        OBSERVED,
        F.count(F.lit(1)).alias("messages"),
        F.count_if(~F.coalesce(usable, F.lit(False))).alias("rejected"),
    )


class RowAccounts(StreamingQueryListener):
    """Keeps the accounts of streams whose messages are ``observed`` in a folder.

    To be used around the start and the end of a stream: ``with RowAccounts(spark, folder) as a``;
    leaving waits until the last batch of ``follow``-ed streams is in the books.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._store = spark, Store(spark, folder)
        self._ended: dict[str, threading.Event] = {}

    def __enter__(self) -> RowAccounts:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        for event in self._ended.values():
            event.wait(60)
        self._spark.streams.removeListener(self)

    def follow(self, query: StreamingQuery) -> StreamingQuery:
        self._ended.setdefault(str(query.runId), threading.Event())
        return query

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(OBSERVED)
        if seen is None:
            return
        row = {
            "batch_id": progress.batchId,
            "messages": seen["messages"],
            "rejected": seen["rejected"],
            "groups_dropped": sum(o.numRowsDroppedByWatermark for o in progress.stateOperators),
        }
        # The same batch of the same stream has the same name, however often it is run.
        self._store.create(f"{progress.id}-{progress.batchId}.json", json.dumps(row))

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self._ended.setdefault(str(event.runId), threading.Event()).set()


def row_accounts(spark: SparkSession, folder: str, table: CampaignTable) -> DataFrame:
    """One row: messages, and how many of them were rejected, late and kept.

    ``table`` has been written by the streams of these accounts only.
    """
    sums = spark.read.schema(ACCOUNTS_SCHEMA).json(folder).agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("messages", "rejected")]
    )
    clicks = table.latest(spark).agg(F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"))
    kept = clicks.scalar()
    late = F.col("messages") - F.col("rejected") - kept
    return sums.select("messages", "rejected", late.alias("late"), kept.alias("kept"))
