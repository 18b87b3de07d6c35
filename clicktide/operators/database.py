"""Upsert into a relational database over any DB-API driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import closing, suppress
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import partial
from itertools import batched, chain
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from clicktide.contracts import (
    AGG_KEYS,
    AGG_TABLE,
    CAMPAIGN_AGG_SCHEMA,
    conform,
    create_table_sql,
    create_views_sql,
    upsert_sql,
)


_TIMES = [f.name for f in CAMPAIGN_AGG_SCHEMA if f.dataType == TimestampType()]
_TIME_PLACES = [CAMPAIGN_AGG_SCHEMA.names.index(name) for name in _TIMES]
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass(frozen=True)
class DatabaseUpsert:
    """Writes aggregates to a table keyed as ``campaign_agg``; running it again changes nothing.

    ``connect`` is called in the tasks and must be picklable. One task writes one partition in one
    transaction and opens no connection when it has no rows. ``max_connections`` spreads the rows by
    key over that many tasks, to protect the database.
    """

    connect: Callable[[], Any]
    table: str = AGG_TABLE
    placeholder: str = "?"
    flush_rows: int = 1000  # fixed value: rows per executemany
    max_connections: int | None = None

    def ensure_table(self) -> None:
        """Make the table and the serving views where they are missing."""
        with closing(self.connect()) as connection:
            cursor = connection.cursor()
            for statement in [create_table_sql(self.table), *create_views_sql(self.table)]:
                cursor.execute(statement)
            connection.commit()

    def write(self, df: DataFrame) -> None:
        rows = with_instants(df)
        if self.max_connections:
            rows = rows.repartition(self.max_connections, *AGG_KEYS)
        rows.foreachPartition(self.write_rows)

    def write_rows(self, rows: Iterable[Row]) -> None:
        source = iter(rows)
        first = next(source, None)
        if first is None:
            return
        with closing(self.connect()) as connection:
            try:
                self._send(connection, chain([first], source))
            except BaseException:
                # A lost connection cannot roll back; the first error is the one to report.
                with suppress(Exception):
                    connection.rollback()
                raise

    def _send(self, connection: Any, rows: Iterator[Row]) -> None:
        statement = upsert_sql(self.table, self.placeholder)
        cursor = connection.cursor()
        for chunk in batched(rows, self.flush_rows):
            cursor.executemany(statement, [with_zones(row) for row in chunk])
        connection.commit()


def with_instants(df: DataFrame) -> DataFrame:
    """The table's columns; times as numbers, as a task would turn them into those of its own zone."""
    return conform(df).withColumns({name: F.unix_micros(name) for name in _TIMES})


def with_zones(row: Row) -> tuple:
    """The row's values, with its times as instants in UTC."""
    values = list(row)
    for at in _TIME_PLACES:
        values[at] = _EPOCH + timedelta(microseconds=values[at])
    return tuple(values)


def postgres_upsert(url: str, **options: Any) -> DatabaseUpsert:
    """Upsert sink for PostgreSQL; the executors need the ``psycopg`` package."""
    return DatabaseUpsert(partial(_connect_postgres, url), placeholder="%s", **options)


def _connect_postgres(url: str) -> Any:
    try:
        import psycopg
    except ImportError as missing:
        raise RuntimeError("install psycopg on every executor to write to PostgreSQL") from missing
    return psycopg.connect(url)
