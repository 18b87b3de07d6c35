"""Row numbers over a whole frame without putting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktide.session import materialize

# monotonically_increasing_id puts the partition number above this many bits of row number.
_ROW_BITS = 33


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in the given total order.

    ``row_number()`` without a partition would pull every row into one task. Here the sort is spread
    by ranges and written once; the position is the row's place in its range plus the sizes of the
    ranges before it. Only one row per range (at most the number of shuffle partitions) goes through
    the running sum and the broadcast. ``order`` must leave no ties, so that a task run twice puts
    its rows in the same places.
    """
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(placed, "rank")
    ranged = placed.withColumn("_range", F.shiftright("_place", _ROW_BITS))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    within = F.col("_place") - F.shiftleft(F.col("_range"), _ROW_BITS)
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_before") + within + 1).cast("long"))
        .select(*df.columns, name)
    )
