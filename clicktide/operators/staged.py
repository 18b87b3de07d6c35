"""Upsert into a relational database, a whole batch or nothing.

Tasks write to a staging table, each attempt under a number of its own. When all are done the driver
moves the attempts that count to the table in one transaction; when the job fails, it deletes them.
So readers see all rows of a batch or none, a task that is run twice counts once, and a batch that is
sent again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from itertools import batched
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from clicktide.contracts import (
    AGG_KEYS,
    AGG_VALUES,
    CAMPAIGN_AGG_SCHEMA,
    SQL_TYPES,
)
from clicktide.operators.database import DatabaseUpsert, with_instants, with_zones

STAGING_SUFFIX = "_staging"


@dataclass
class Staged(WriterCommitMessage):
    """An attempt of a task that has staged its rows."""

    attempt: str
    rows: int


def create_staging_sql(table: str) -> str:
    columns = [f"{field.name} {SQL_TYPES[field.dataType]}" for field in CAMPAIGN_AGG_SCHEMA]
    return f"CREATE TABLE IF NOT EXISTS {table} (batch TEXT, attempt TEXT, {', '.join(columns)})"


def stage_sql(table: str, placeholder: str) -> str:
    names = ["batch", "attempt", *CAMPAIGN_AGG_SCHEMA.names]
    return f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join([placeholder] * len(names))})"


def move_sql(staging: str, table: str, placeholder: str) -> str:
    """Upsert what one attempt has staged."""
    names = ", ".join(CAMPAIGN_AGG_SCHEMA.names)
    replaced = ", ".join(f"{name} = EXCLUDED.{name}" for name in AGG_VALUES)
    return (
        f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging} "
        f"WHERE batch = {placeholder} AND attempt = {placeholder} "
        f"ON CONFLICT ({', '.join(AGG_KEYS)}) DO UPDATE SET {replaced}"
    )


class StagedWriter(DataSourceWriter):
    def __init__(self, upsert: DatabaseUpsert, batch: str) -> None:
        self._upsert, self._batch = upsert, batch
        self._staging = upsert.table + STAGING_SUFFIX

    def write(self, iterator: Iterator[Row]) -> Staged:
        attempt, count = uuid.uuid4().hex, 0
        statement = stage_sql(self._staging, self._upsert.placeholder)
        with closing(self._upsert.connect()) as connection:
            cursor = connection.cursor()
            for chunk in batched(iterator, self._upsert.flush_rows):
                cursor.executemany(statement, [(self._batch, attempt, *with_zones(r)) for r in chunk])
                count += len(chunk)
            connection.commit()
        return Staged(attempt, count)

    def commit(self, messages: Sequence[Staged | None]) -> None:
        move = move_sql(self._staging, self._upsert.table, self._upsert.placeholder)
        attempts = [(self._batch, m.attempt) for m in messages if m and m.rows]
        with closing(self._upsert.connect()) as connection:
            cursor = connection.cursor()
            if attempts:
                cursor.executemany(move, attempts)
            self._forget(cursor)
            connection.commit()

    def abort(self, messages: Sequence[Staged | None]) -> None:
        with closing(self._upsert.connect()) as connection:
            self._forget(connection.cursor())
            connection.commit()

    def _forget(self, cursor: Any) -> None:
        mark = self._upsert.placeholder
        cursor.executemany(f"DELETE FROM {self._staging} WHERE batch = {mark}", [(self._batch,)])


def staged_source(upsert: DatabaseUpsert) -> type[DataSource]:
    """A data source that writes batches to the table of ``upsert``."""

    class CampaignAggSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"staged_{upsert.table}"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return StagedWriter(upsert, uuid.uuid4().hex)

    return CampaignAggSource


@dataclass(frozen=True)
class StagedUpsert:
    """Writes aggregates as ``DatabaseUpsert`` does, but all rows of a batch at once."""

    upsert: DatabaseUpsert

    def ensure_table(self) -> None:
        self.upsert.ensure_table()
        with closing(self.upsert.connect()) as connection:
            connection.cursor().execute(create_staging_sql(self.upsert.table + STAGING_SUFFIX))
            connection.commit()

    def write(self, df: DataFrame) -> None:
        source = staged_source(self.upsert)
        df.sparkSession.dataSource.register(source)
        rows = with_instants(df)
        if self.upsert.max_connections:
            rows = rows.repartition(self.upsert.max_connections, *AGG_KEYS)
        rows.write.format(source.name()).mode("append").save()
