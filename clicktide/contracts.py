"""Schemas and SQL text of the two data sets: click events and ``campaign_agg``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The JSON fields of one event.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_time", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("campaign_id", T.StringType()),
        T.StructField("ad_id", T.StringType()),
        T.StructField("clicked", T.BooleanType()),
    ]
)

# The columns of the aggregate table.
CAMPAIGN_AGG_SCHEMA = T.StructType(
    [
        T.StructField("window_start", T.TimestampType(), False),
        T.StructField("window_end", T.TimestampType(), False),
        T.StructField("campaign_id", T.StringType(), False),
        T.StructField("clicks", T.LongType(), False),
        T.StructField("unique_users", T.LongType(), False),
        T.StructField("ctr", T.DoubleType(), True),
    ]
)

AGG_TABLE = "campaign_agg"
AGG_KEYS = ("window_start", "window_end", "campaign_id")
AGG_VALUES = ("clicks", "unique_users", "ctr")

# SQL names of the column types.
SQL_TYPES = {
    T.TimestampType(): "TIMESTAMPTZ",
    T.StringType(): "TEXT",
    T.LongType(): "BIGINT",
    T.DoubleType(): "DOUBLE PRECISION",
}


def conform(df: DataFrame) -> DataFrame:
    """Select the table's columns with its types; a NULL in a NOT NULL column fails the job."""
    columns = []
    for field in CAMPAIGN_AGG_SCHEMA:
        value = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            complaint = F.raise_error(F.lit(f"{AGG_TABLE}.{field.name} must not be NULL"))
            value = F.coalesce(value, complaint.cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def create_table_sql(table: str = AGG_TABLE) -> str:
    """DDL that makes the keyed table in a relational database when it is missing."""
    columns = [
        f"{f.name} {SQL_TYPES[f.dataType]}{'' if f.nullable else ' NOT NULL'}"
        for f in CAMPAIGN_AGG_SCHEMA
    ]
    columns.append(f"PRIMARY KEY ({', '.join(AGG_KEYS)})")
    return f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(columns)})"


def create_views_sql(table: str = AGG_TABLE) -> list[str]:
    """DDL of the two serving views: the newest window, and totals per campaign."""
    columns = ", ".join(CAMPAIGN_AGG_SCHEMA.names)
    return [
        f"CREATE OR REPLACE VIEW latest_campaign_window AS SELECT {columns} FROM {table} "
        f"WHERE window_end = (SELECT max(window_end) FROM {table})",
        "CREATE OR REPLACE VIEW campaign_totals AS SELECT campaign_id, sum(clicks) AS clicks, "
        f"sum(unique_users) AS unique_users FROM {table} GROUP BY campaign_id",
    ]


def upsert_sql(table: str = AGG_TABLE, placeholder: str = "?") -> str:
    """Insert-or-replace statement with one placeholder per column, in schema order."""
    names = CAMPAIGN_AGG_SCHEMA.names
    marks = ", ".join([placeholder] * len(names))
    replaced = ", ".join(f"{name} = EXCLUDED.{name}" for name in AGG_VALUES)
    return (
        f"INSERT INTO {table} ({', '.join(names)}) VALUES ({marks}) "
        f"ON CONFLICT ({', '.join(AGG_KEYS)}) DO UPDATE SET {replaced}"
    )
