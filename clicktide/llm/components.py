"""Connected components of a graph of links, by hooking to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktide.llm.skew import join_counted
from clicktide.session import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    """Two numbers that change if a set of distinct edges does."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"),
    ).first()
    return row["n"], row["sum"]


def _star(pairs: DataFrame, large: bool, purpose: str) -> DataFrame:
    """Each node's neighbours, itself included, hooked to the smallest of them.

    ``large``: only those above the node are hooked, else those up to the node. A node with many
    neighbours is sent to their rows instead of the other way round.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    counted = both.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
    # What is smallest may be the node itself.
    smallest = materialize(counted.select("a", F.least("a", "low").alias("low"), "n"), purpose)
    total = smallest.agg(F.sum("n")).first()[0] or 0
    if large:
        hooked = join_counted(both.where("b > a"), smallest, "a", total)
        hooked = hooked.select(F.col("b").alias("a"), "low")
    else:
        hooked = (
            join_counted(both, smallest, "a", total)
            .select(F.col("b").alias("a"), "low")
            .unionByName(smallest.select("a", "low"))
        )
    return hooked.where("a <> low").select("a", F.col("low").alias("b")).distinct()


def components(edges: DataFrame, purpose: str = "components", max_rounds: int = 60) -> DataFrame:
    """Per node with an edge, but the smallest of each component: ``node`` and that ``root``.

    ``edges`` has columns a and b of numbers. Large and small stars alternate until nothing changes;
    the number of rounds grows with the logarithm of the longest path. Every round is a written
    table, so a lost executor costs one round at most. No edges give no rows.
    """
    now = materialize(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        purpose,
    )
    last = _fingerprint(now)
    for _ in range(max_rounds):
        if not last[0]:
            break
        now = materialize(_star(now, True, purpose), purpose)
        now = materialize(_star(now, False, purpose), purpose)
        found = _fingerprint(now)
        if found == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = found
    if last[0]:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
