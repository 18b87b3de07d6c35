"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys that are sent to all tasks are no more than this, by how they are chosen.
BROADCAST_KEYS = 50_000
# Keys with up to this many rows are never sent.
FEW_ROWS = 64


def frequent_bound(rows: int) -> int:
    """Of so many rows, at most ``BROADCAST_KEYS`` keys can have more than this each."""
    return max(FEW_ROWS, -(-rows // BROADCAST_KEYS))


def join_counted(rows: DataFrame, once: DataFrame, on: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``once``, a written table that has each key of ``on`` once.

    Its column ``n`` says how many of the ``total`` rows have the key. Rows of frequent keys stay
    where they are and get a copy of these keys' part of ``once``, which is bounded by
    ``BROADCAST_KEYS`` at any size; all others are shuffled, a bounded number per key.
    """
    bound = frequent_bound(total)
    frequent = once.where(F.col("n") > bound)
    if frequent.isEmpty():
        return rows.join(once, on)
    stay = rows.join(F.broadcast(frequent), on)
    others = rows.join(F.broadcast(frequent.select(on)), on, "left_anti")
    return stay.unionByName(others.join(once.where(F.col("n") <= bound), on))
