"""Event sources: topic, landed JSON lines, and the ``events`` test table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from clicktide.functions.times import micros, moment
from clicktide.sources.settings import KafkaSettings

EVENT_TABLE_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


# By default a file that is a week older than the newest would be passed over.
MAX_FILE_AGE = "36500d"
# Folders that landed messages are kept in.
LANDED_FOLDERS = {"event_date", "event_hour"}


def kafka_stream(spark: SparkSession, settings: KafkaSettings) -> DataFrame:
    """Raw messages of the topic. Needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").options(**settings.source_options())
    return reader.load().select("value")


def landed_stream(
    spark: SparkSession,
    path: str,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
) -> DataFrame:
    """Raw messages as JSON lines in files, one message per line, in column ``value``.

    A batch takes files up to a number or up to a size, whichever is given; at least one. Files are taken oldest first, whatever their age. (Newest first would let the watermark drop
    what the older files hold.) Folders below the path are read too.
    """
    if max_files_per_trigger and max_bytes_per_trigger:
        raise ValueError("bound a batch by files or by bytes, not by both")
    reader = _all_files(spark.readStream.format("text"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    return reader.load(path)


def _all_files(reader: DataStreamReader) -> DataStreamReader:
    return (
        reader.option("latestFirst", "false")
        .option("maxFileAge", MAX_FILE_AGE)
        .option("recursiveFileLookup", "true")
    )


def landed_batch(
    spark: SparkSession, path: str, since: datetime | Column | None = None
) -> DataFrame:
    """The same JSON lines as a batch.

    With ``since`` only the hour folders from then on are read, if the files lie in such folders;
    what is in them from before that time is still there.
    """
    lines = spark.read.text(path)
    if since is not None and LANDED_FOLDERS <= set(lines.columns):
        start = moment(since).cast("timestamp")
        day, hour = F.col("event_date").cast("date"), F.col("event_hour").cast("int")
        lines = lines.where(
            (day > F.to_date(start)) | ((day == F.to_date(start)) & (hour >= F.hour(start)))
        )
    return lines.select("value")


def throttle(events_per_second: float, trigger: str) -> int:
    """Offsets per trigger interval, such as ``5 seconds``, that keep ingest at a wanted rate."""
    interval = micros(trigger)
    if events_per_second <= 0 or interval <= 0:
        raise ValueError("rate and trigger interval must be positive")
    return max(1, int(events_per_second * interval / 10**6))


def _three_digits(number: Column) -> Column:
    """Zero-padded to at least three digits; several times faster than ``format_string``."""
    text = number.cast("string")
    return F.when(number < 1000, F.lpad(text, 3, "0")).otherwise(text)


def as_events(table: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Give the ``events`` table the shape of decoded click events; works for batch and stream.

    The table has no campaign, so one of four is derived from the number in ``props``.
    """
    # props is {"k": <number>} throughout; a pattern reads it in a third of the JSON parser's time.
    k = F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).try_cast("int")
    return table.select(
        *carry,
        F.col("ts").alias("event_time"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("cmp-"), _three_digits(k % 4 + 1)).alias("campaign_id"),
        F.concat(F.lit("ad-"), _three_digits(k)).alias("ad_id"),
        (F.col("event_type") == "click").alias("clicked"),
    )


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENT_TABLE_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def event_batch(spark: SparkSession, sf_dir: str, carry: Sequence[str] = ()) -> DataFrame:
    """All events of the test table, as a batch."""
    return as_events(event_table(spark, sf_dir), carry)


def event_table_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Events of the test table's shape, as a stream of Parquet files in a folder.

    Rows without a time or a campaign, which the aggregate's key doesn't allow, are left out;
    ``event_table_rejects`` returns exactly these.
    """
    events = as_events(_table_files(spark, path, max_files_per_trigger))
    usable = events.where(_table_reason().isNull())
    return usable.withColumn("event_time", F.col("event_time").cast("timestamp"))


def event_table_rejects(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The rows that ``event_table_stream`` leaves out, as JSON in ``value`` with the reason."""
    rows = _table_files(spark, path, max_files_per_trigger)
    whole = F.to_json(F.struct(*[field.name for field in EVENT_TABLE_SCHEMA])).alias("row")
    judged = as_events(rows.select("*", whole), carry=["row"])
    judged = judged.select(F.col("row").alias("value"), _table_reason().alias("reason"))
    return judged.where("reason is not null")


def _table_reason() -> Column:
    """Why an event of the table cannot be used; NULL when it can."""
    return F.when(F.col("event_time").isNull(), "no_event_time").when(
        F.col("campaign_id").isNull(), "no_campaign"
    )


def _table_files(spark: SparkSession, path: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = _all_files(spark.readStream.schema(EVENT_TABLE_SCHEMA))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)
