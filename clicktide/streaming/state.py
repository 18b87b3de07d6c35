"""What a stream has in its state, read from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windows_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Windows and campaigns that the stream still counts, as of its last batch.

    The stream must use the state store that the session is set to, or be stopped.
    """
    rows = spark.read.format("statestore").load(checkpoint)
    return rows.select(
        F.col("key.window.start").alias("window_start"),
        F.col("key.window.end").alias("window_end"),
        F.col("key.campaign_id").alias("campaign_id"),
    )


def state_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful operators of a stream, their partitions and the batches there is state of."""
    rows = spark.read.format("state-metadata").load(checkpoint)
    return rows.select("operatorName", "numPartitions", "minBatchId", "maxBatchId")
