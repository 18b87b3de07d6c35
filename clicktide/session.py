"""Session settings and the folder that every executor can see."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_local_folders: dict[str, str] = {}


def build_session(
    app: str = "clicktide",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    large_state: bool = False,
) -> SparkSession:
    """Session in UTC with AQE; ``large_state`` keeps stream state in RocksDB instead of the heap.

    The number of shuffle partitions is frozen into a stream's checkpoint, so choose it before the
    first start.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.bindAddress", "127.0.0.1")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if large_state:
        builder = builder.config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return use_utc(builder.getOrCreate())


def use_utc(spark: SparkSession) -> SparkSession:
    """Event times and windows are UTC whatever zone the machine is in."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def session_options(spark: SparkSession, options: dict[str, str | None]) -> Iterator[None]:
    """Set options for a while. A stream copies its session's settings when it starts."""
    wanted = {key: value for key, value in options.items() if value is not None}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where driver and executors are one process may it be unset; a temporary folder serves then.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="clicktide-")
    return _local_folders[app]


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder, used by nobody else and deleted when the driver ends."""
    name = f"{shared_folder(spark)}/clicktide/{purpose}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts lineage, survives the loss of executors, and fixes values such as generated ids.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
