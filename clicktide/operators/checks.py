"""Counting the rows that break the contract of ``campaign_agg``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.contracts import AGG_KEYS, CAMPAIGN_AGG_SCHEMA


def _row_problems() -> dict[str, Column]:
    required = [f.name for f in CAMPAIGN_AGG_SCHEMA if not f.nullable]
    problems = {f"null_{name}": F.col(name).isNull() for name in required}
    problems["empty_window"] = F.col("window_end") <= F.col("window_start")
    problems["negative_clicks"] = F.col("clicks") < 0
    problems["negative_unique_users"] = F.col("unique_users") < 0
    return problems


def contract_violations(df: DataFrame) -> DataFrame:
    """``(violation, n_rows)`` for every rule, zero included.

    One shuffle on the key with counts already combined per task; a key with any number of copies is
    one row by then. ``duplicate_key`` counts the rows beyond the first of each complete key.
    """
    counts = [F.count_if(rule).alias(name) for name, rule in _row_problems().items()]
    per_key = df.groupBy(*AGG_KEYS).agg(F.count(F.lit(1)).alias("copies"), *counts)
    complete = F.lit(True)
    for key in AGG_KEYS:
        complete = complete & F.col(key).isNotNull()
    names = [*_row_problems(), "duplicate_key"]
    per_key = per_key.withColumn(
        "duplicate_key", F.when(complete, F.col("copies") - 1).otherwise(0)
    )
    totals = per_key.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return totals.unpivot([], names, "violation", "n_rows")


def require_contract(df: DataFrame) -> None:
    """Raise when any rule is broken. Brings only the broken rules to the driver."""
    broken = contract_violations(df).where("n_rows > 0").collect()
    if broken:
        listed = ", ".join(f"{row.violation}={row.n_rows}" for row in broken)
        raise ValueError(f"rows break the aggregate contract: {listed}")
