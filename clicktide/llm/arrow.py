"""Small helpers for functions that Spark runs over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Batches = Iterable[pa.RecordBatch]

# Rows per call of a per-text function: long texts must not pile up in one Python list.
TEXTS_PER_STEP = 256


def per_row(
    rows: DataFrame, column: str, schema: StructType, make: Callable[[], Callable[[list], list]]
) -> DataFrame:
    """Replace ``column`` by what a function returns for it; the other columns stay.

    ``schema`` is that of the whole result, whose first columns are those of ``rows`` without
    ``column``. ``make`` builds the function in the task, so that it can hold a model; the function
    gets a list of values and returns as many tuples, one for each row.
    """
    keep = [name for name in rows.columns if name != column]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        function, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_PER_STEP):
                part = batch.slice(at, TEXTS_PER_STEP)
                made = list(zip(*function(part.column(column).to_pylist())))
                kept = [part.column(name).cast(arrow.field(name).type) for name in keep]
                new = [
                    pa.array(values, type=field.type)
                    for values, field in zip(made, list(arrow)[len(keep) :], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(kept + new, schema=arrow)

    return rows.mapInArrow(run, schema)


def keep_rows(
    rows: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]
) -> DataFrame:
    """The rows of which a function of ``column`` says true, with all their columns."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_PER_STEP):
                part = batch.slice(at, TEXTS_PER_STEP)
                good = function(part.column(column).to_pylist())
                yield part.filter(pa.array(good, type=pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def groups(batches: Batches, keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups, one after another, from batches that are sorted by ``keys``.

    Only the rows of the group at hand are held.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(key).to_numpy(zero_copy_only=False) for key in keys]
        changed = np.zeros(batch.num_rows, dtype=bool)
        for values in columns:
            changed[1:] |= values[1:] != values[:-1]
        first = tuple(values[0] for values in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if held and start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
        last = tuple(values[-1] for values in columns)
    if held:
        yield pa.Table.from_batches(held)
