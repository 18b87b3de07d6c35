"""Reading ``campaign_agg`` from a database (the file table is in ``operators.table``)."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from clicktide.contracts import AGG_TABLE


def partitioned_jdbc_options(
    options: Mapping[str, str],
    lower: datetime,
    upper: datetime,
    readers: int,
    table: str = AGG_TABLE,
) -> dict[str, str]:
    """JDBC options that split the scan by ``window_end`` over several readers.

    The bounds only place the splits: rows outside them are read too, by the first and last reader.
    """
    if lower >= upper:
        raise ValueError("lower bound must be before upper bound")
    return {
        **options,
        "dbtable": table,
        "partitionColumn": "window_end",
        "lowerBound": lower.strftime("%Y-%m-%d %H:%M:%S"),
        "upperBound": upper.strftime("%Y-%m-%d %H:%M:%S"),
        "numPartitions": str(max(1, readers)),
        "pushDownPredicate": "true",
    }


def read_database(
    spark: SparkSession,
    options: Mapping[str, str],
    lower: datetime | None = None,
    upper: datetime | None = None,
    readers: int = 8,
) -> DataFrame:
    """``campaign_agg`` from a database; filters and column choice go to the database.

    Without bounds one reader takes what the filters leave, which fits a dashboard's slice.
    """
    if lower and upper:
        chosen = partitioned_jdbc_options(options, lower, upper, readers)
    else:
        chosen = {**options, "dbtable": AGG_TABLE, "pushDownPredicate": "true"}
    return spark.read.format("jdbc").options(**chosen).load()
