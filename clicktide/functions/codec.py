"""JSON messages to typed events and back, with a place for the messages that cannot be used."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clicktide.contracts import EVENT_SCHEMA

# Fixed value: ISO-8601 with milliseconds and offset.
EVENT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


# What the aggregate needs of an event besides its time.
AGGREGATE_FIELDS = ("user_id", "campaign_id")


def _parse(raw: DataFrame, carry: Sequence[str], schema: StructType = EVENT_SCHEMA) -> DataFrame:
    text = F.col("value").cast("string")
    return raw.select(*carry, text.alias("value"), F.from_json(text, schema).alias("e"))


def _event_time() -> Column:
    # try_: under ANSI mode a plain cast would end the query at the first bad message.
    return F.try_to_timestamp(F.col("e.event_time"))


def _reason(keep_null_campaign: bool) -> Column:
    """Why a parsed message cannot be used; NULL when it can."""
    nothing = F.lit(True)
    for name in EVENT_SCHEMA.names:
        nothing = nothing & F.col(f"e.{name}").isNull()
    reason = (
        F.when(nothing, "not_an_event")
        .when(F.col("e.event_time").isNull(), "no_event_time")
        .when(F.col("event_time").isNull(), "bad_event_time")
    )
    if keep_null_campaign:
        return reason
    return reason.when(F.col("e.campaign_id").isNull(), "no_campaign")


def _rows_where(condition: Column, *fields: Column | str) -> Column:
    """The fields as a row where the condition holds, and no row elsewhere.

    A plain filter would be pushed below the projection and parse each message again, once per
    column it looks at; a generator keeps it at one parse.
    """
    return F.inline(F.when(condition, F.array(F.struct(*fields))))


def decode_events(
    raw: DataFrame,
    carry: Sequence[str] = (),
    keep_null_campaign: bool = False,
    fields: Sequence[str] | None = None,
    watch: Callable[[DataFrame, Column], DataFrame] | None = None,
) -> DataFrame:
    """Typed events from messages in column ``value``; ``carry`` names source columns to keep.

    ``fields`` are the fields to parse besides the time, all by default. (Spark can't leave out
    columns that nobody uses behind the generator that drops messages.) ``watch`` gets the parsed
    messages and which of them are usable, before the others are dropped.

    Messages without a usable time belong to no window and are left out; so are those without a
    campaign, which the aggregate table's key does not allow (``keep_null_campaign`` lets them
    through). ``decode_rejects`` returns exactly the messages left out.
    """
    names = [f.name for f in EVENT_SCHEMA if f.name != "event_time"]
    others = [name for name in names if fields is None or name in fields]
    wanted = {"event_time", "campaign_id", *others}
    schema = StructType([field for field in EVENT_SCHEMA if field.name in wanted])
    parsed = _parse(raw, carry, schema).select(*carry, "e", _event_time().alias("event_time"))
    usable = F.col("event_time").isNotNull()
    if not keep_null_campaign:
        usable = usable & F.col("e.campaign_id").isNotNull()
    if watch:
        parsed = watch(parsed, usable)
    kept = [f"e.{name}" for name in others]
    return parsed.select(*carry, _rows_where(usable, "event_time", *kept))


def decode_rejects(
    raw: DataFrame, carry: Sequence[str] = (), keep_null_campaign: bool = False
) -> DataFrame:
    """The messages that ``decode_events`` leaves out, with the reason."""
    parsed = _parse(raw, carry).select("*", _event_time().alias("event_time"))
    judged = parsed.select(*carry, "value", _reason(keep_null_campaign).alias("reason"))
    return judged.select(*carry, _rows_where(F.col("reason").isNotNull(), "value", "reason"))


def encode_events(events: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One JSON message per event in column ``value``; times in UTC, cut to milliseconds."""
    fields = [
        F.date_format(F.col("event_time").cast("timestamp"), EVENT_TIME_FORMAT).alias("event_time"),
        *[F.col(name) for name in EVENT_SCHEMA.names if name != "event_time"],
    ]
    return events.select(*carry, F.to_json(F.struct(*fields)).alias("value"))
