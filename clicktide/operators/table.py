"""``campaign_agg`` as Parquet files: a changelog with last-write-wins reading.

Every write is a folder of its own, ``version=N/window_date=D/part-*``, with the next number of the
table: the number is taken by making ``version=N/_claim``, a file that must not exist yet, and the
write counts from when ``version=N/_done`` is there. A write that fails, or is half done, is never
seen and holds nothing up; done again, it gets a new number. Later numbers win, whoever writes.

A fold brings the newest row of each key of the dates with new writes together in
``folded/window_date=D/fold=F``; each row keeps the number that it was written with. ``folds/I`` says
which writes and which fold of each date count, by their numbers. A write that isn't in that list,
such as one that was under way during the fold, is read beside the folds whenever it gets done, and
its number decides as ever. So writers and folds may run side by side in any order.

Dates give partition pruning. Inside a file rows are sorted by window end, so that statistics of row
groups prune a recent slice; folds of dates before the newest, which nobody asks for by the minute,
are sorted by campaign, so that one campaign's history is a row group per date. All files have Bloom
filters of the campaign too: a reader passes over row groups that a campaign isn't in.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicktide.contracts import AGG_KEYS, AGG_VALUES, CAMPAIGN_AGG_SCHEMA, conform
from clicktide.functions.store import Store
from clicktide.functions.times import moment
from clicktide.operators.checks import require_contract
from clicktide.session import session_options

CHANGELOG_SCHEMA = T.StructType(
    [
        *CAMPAIGN_AGG_SCHEMA.fields,
        T.StructField("window_date", T.DateType()),
        T.StructField("version", T.LongType()),
    ]
)

# Campaigns that a file's Bloom filter is made for, the size of a row group and rows of a page.
BLOOM_CAMPAIGNS = 100_000
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 1_000

# The window's end in microseconds since 1970, a column of the files only.
END_NUMBER = "window_end_us"

# Times as numbers, whose statistics can be used; by default they are written in a form without.
FILE_OPTIONS = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}
FOOTER_OPTIONS = {
    "spark.sql.sources.useV1SourceList": "",
    "spark.sql.parquet.aggregatePushdown": "true",
}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

# The last number that this process knows to be taken, by table.
_last_claims: dict[str, int] = {}


@dataclass(frozen=True)
class Versions:
    """A set of write numbers: all up to one, without some."""

    through: int = -1
    without: frozenset[int] = frozenset()

    def __contains__(self, number: int) -> bool:
        return number <= self.through and number not in self.without

    def and_also(self, numbers: Iterable[int]) -> Versions:
        more = set(numbers)
        through = max(more | {self.through})
        missing = self.without | set(range(self.through + 1, through + 1))
        return Versions(through, frozenset(missing - more))

    def within(self, other: Versions) -> bool:
        missing = {n for n in other.without if n in self}
        missing |= {n for n in range(other.through + 1, self.through + 1) if n in self}
        return not missing

    def condition(self, column: Column) -> Column:
        return (column <= self.through) & ~column.isin(*self.without)

    def as_json(self) -> dict:
        return {"through": self.through, "without": sorted(self.without)}

    @staticmethod
    def of_json(found: dict) -> Versions:
        return Versions(found["through"], frozenset(found["without"]))


@dataclass(frozen=True)
class Fold:
    """What a file in ``folds`` says: the writes that are folded and the fold of each date."""

    number: int = -1
    versions: Versions = Versions()
    dates: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class CampaignTable:
    root: str

    # --- writing -------------------------------------------------------------------------------

    def upsert(self, df: DataFrame, files: int | None = None, check: bool = False) -> int:
        """Write full values for the keys in ``df``; later writes win over earlier ones.

        ``df`` holds each key once, as an aggregate does; ``check`` verifies that first, at the cost
        of a second pass. ``files`` is the number of files per date: AQE sizes them otherwise.
        Returns the number of the write. The same rows written twice are harmless.
        """
        if check:
            require_contract(df)
        return self.write_claimed(df, self.claim(df.sparkSession), files)

    def write_claimed(self, df: DataFrame, number: int, files: int | None = None) -> int:
        """The write itself, under a number that has been claimed before."""
        self._write(conform(df), f"{self.root}/version={number}", ["window_date"], files)
        self.finish(df.sparkSession, number)
        return number

    def claim(self, spark: SparkSession) -> int:
        """Take the next number of the table, which no other writer gets."""
        store = Store(spark, self.root)
        number = _last_claims.get(self.root)
        if number is None:
            number = max(self._numbers(store, "_claim"), default=-1)
        while True:
            # Below a fold's last number the folders of writes may have been deleted.
            number = max(number, self.last_fold(spark).versions.through) + 1
            if store.create(f"version={number}/_claim"):
                if number > self.last_fold(spark).versions.through:
                    break
        _last_claims[self.root] = number
        return number

    def finish(self, spark: SparkSession, number: int) -> None:
        """From now on the write counts."""
        Store(spark, self.root).create(f"version={number}/_done")

    @staticmethod
    def _write(
        df: DataFrame,
        path: str,
        folders: list[str],
        files: int | None,
        order: tuple[str, str] = ("window_end", "campaign_id"),
        row_group_bytes: int = ROW_GROUP_BYTES,
    ) -> None:
        """Bring the rows of a date together, so that not every task writes a file for every date.

        AQE sizes the tasks: it joins small dates and splits large ones. With ``files`` a date is
        spread by key over that many tasks instead, whatever its size.
        """
        rows = df.withColumn("window_date", F.to_date("window_end"))
        # Parquet keeps the greatest number of a file in its footer, but Spark asks for no time there,
        # and looks for the column at its place in the schema that is read: so it comes first.
        rows = rows.select(F.unix_micros("window_end").alias(END_NUMBER), "*")
        if files:
            rows = rows.repartition("window_date", F.pmod(F.xxhash64(*AGG_KEYS), F.lit(files)))
        else:
            rows = rows.hint("rebalance", "window_date")
        writer = rows.sortWithinPartitions("window_date", *order).write
        with session_options(df.sparkSession, FILE_OPTIONS):
            (
                writer.mode("append")
                .option("parquet.bloom.filter.enabled#campaign_id", "true")
                .option("parquet.bloom.filter.expected.ndv#campaign_id", str(BLOOM_CAMPAIGNS))
                .option("parquet.bloom.filter.adaptive.enabled", "true")
                .option("parquet.block.size", str(row_group_bytes))
                .option("parquet.page.row.count.limit", str(PAGE_ROWS))
                .partitionBy(*folders)
                .parquet(path)
            )

    # --- reading -------------------------------------------------------------------------------

    def changelog(self, spark: SparkSession, dates: Iterable[date] | None = None) -> DataFrame:
        """Rows of all writes since the folds, and of the folds; no rows before the first write.

        Folded writes aren't read, so they may be deleted once earlier readers are done. ``dates``
        keeps the windows that end on these days and reads only their folders.
        """
        fold, new = self.last_fold(spark), self.unfolded(spark)
        rows = spark.createDataFrame([], CHANGELOG_SCHEMA)
        if fold.dates:
            folders = [f"window_date={day}/fold={name}" for day, name in fold.dates.items()]
            rows = self._folders(spark, f"{self.root}/folded", folders).unionByName(rows)
        if new:
            folders = [f"version={number}" for number in new]
            rows = self._folders(spark, self.root, folders).unionByName(rows)
        if dates is not None:
            rows = rows.where(F.col("window_date").isin(list(dates)))
        return rows

    @staticmethod
    def _folders(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
        reader = spark.read.schema(CHANGELOG_SCHEMA).option("basePath", root)
        return reader.parquet(*[f"{root}/{name}" for name in folders]).select(*CHANGELOG_SCHEMA.names)

    def latest(
        self, spark: SparkSession, since: datetime | date | Column | None = None
    ) -> DataFrame:
        """The current row of each key.

        ``since`` keeps windows that end on that day (in UTC) or later and reads only those date
        folders.
        """
        rows = self.changelog(spark)
        if since is not None:
            point = moment(since) if isinstance(since, datetime) else since
            bound = point if isinstance(point, Column) else F.lit(point)
            rows = rows.where(F.col("window_date") >= bound.cast("date"))
        return self._newest(rows).drop("version")

    def newest_date(self, spark: SparkSession) -> date | None:
        """The last date that has rows, by the names of folders."""
        days = {date.fromisoformat(day) for day in self.last_fold(spark).dates}
        return max(days | self.dates_of(spark, self.unfolded(spark)), default=None)

    def newest_end(self, spark: SparkSession) -> datetime | None:
        """The end of the newest window, from the footers of the last date's files; no row is read."""
        rows = self._end_numbers(spark)
        if rows is None:
            return None
        # Only the second version of Spark's Parquet source asks the footers.
        with session_options(spark, FOOTER_OPTIONS):
            last = self.max_end(rows).first()[0]
        return None if last is None else _EPOCH + timedelta(microseconds=last)

    @staticmethod
    def max_end(numbers: DataFrame) -> DataFrame:
        return numbers.agg(F.max(END_NUMBER).alias(END_NUMBER))

    def _end_numbers(self, spark: SparkSession) -> DataFrame | None:
        """The ends in the files of the last date."""
        day = self.newest_date(spark)
        if day is None:
            return None
        store, fold = Store(spark, self.root), self.last_fold(spark)
        folders = store.paths(f"version=*/window_date={day.isoformat()}")
        new = {f"version={number}" for number in self.unfolded(spark)}
        found = [path for path in folders if path.split("/")[0] in new]
        if name := fold.dates.get(day.isoformat()):
            found.append(f"folded/window_date={day.isoformat()}/fold={name}")
        with session_options(spark, FOOTER_OPTIONS):
            reader = spark.read.schema(f"{END_NUMBER} long")
            return reader.parquet(*[f"{self.root}/{path}" for path in found])

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        newest = [F.max_by(name, "version").alias(name) for name in AGG_VALUES]
        return rows.groupBy(*AGG_KEYS).agg(*newest, F.max("version").alias("version"))

    # --- what there is ---------------------------------------------------------------------------

    def done(self, spark: SparkSession) -> list[int]:
        """Numbers of the writes that count and whose folders are still there."""
        return self._numbers(Store(spark, self.root), "_done")

    def unfolded(self, spark: SparkSession) -> list[int]:
        """Numbers of the writes that count and aren't in the last fold."""
        folded = self.last_fold(spark).versions
        return [number for number in self.done(spark) if number not in folded]

    def dates_of(self, spark: SparkSession, numbers: Iterable[int]) -> set[date]:
        """The dates of some writes, by the names of folders."""
        wanted = set(numbers)
        found = set()
        for path in Store(spark, self.root).paths("version=*/window_date=*"):
            version, day = [part.split("=")[1] for part in path.split("/")]
            if int(version) in wanted:
                found.add(date.fromisoformat(day))
        return found

    def last_fold(self, spark: SparkSession) -> Fold:
        store = Store(spark, self.root)
        number = max((int(path.split("/")[1]) for path in store.paths("folds/*")), default=None)
        if number is None:
            return Fold()
        found = json.loads(store.read(f"folds/{number}"))
        return Fold(number, Versions.of_json(found["versions"]), found["dates"])

    @staticmethod
    def _numbers(store: Store, mark: str) -> list[int]:
        paths = store.paths(f"version=*/{mark}")
        return sorted(int(path.split("/")[0].removeprefix("version=")) for path in paths)

    # --- upkeep --------------------------------------------------------------------------------

    def compact(
        self, spark: SparkSession, files: int | None = None, within: Versions | None = None
    ) -> list[date]:
        """Fold the writes that are done, for the dates they have; returns these dates.

        May run beside writers and other folds: of two folds that start from the same one, the first
        to finish counts. ``within`` leaves other writes for later.
        """
        store, before = Store(spark, self.root), self.last_fold(spark)
        new = [n for n in self.unfolded(spark) if within is None or n in within]
        days = self.dates_of(spark, new)
        if len(new) < 2 and not {day.isoformat() for day in days} & set(before.dates):
            return []
        versions, name = before.versions.and_also(new), uuid.uuid4().hex
        # Another fold may be done by now; only what this one names may go into it.
        rows = self.changelog(spark, days).where(versions.condition(F.col("version")))
        named = self._newest(rows).withColumn("fold", F.lit(name))
        newest = self.newest_date(spark)
        for some, order in (
            (days & {newest}, ("window_end", "campaign_id")),
            (days - {newest}, ("campaign_id", "window_end")),
        ):
            if some:
                part = named.where(F.to_date("window_end").isin(list(some)))
                self._write(part, f"{self.root}/folded", ["window_date", "fold"], files, order)
        dates = before.dates | {day.isoformat(): name for day in days}
        text = json.dumps({"versions": versions.as_json(), "dates": dates})
        if not store.create(f"folds/{before.number + 1}", text):
            for day in days:
                store.delete(f"folded/window_date={day.isoformat()}/fold={name}")
            return []
        return sorted(days)

    def vacuum(self, spark: SparkSession, retention_seconds: float = 3600) -> list[str]:
        """Delete folders that readers have not looked at since a fold.

        They go once the fold's file is older than ``retention_seconds``, which is the time a reader
        has to finish with the file list it started from. Works on names only.
        """
        store, old = Store(spark, self.root), []
        numbers = sorted(int(path.split("/")[1]) for path in store.paths("folds/*"))
        for number in numbers:
            if time.time() - store.seconds(f"folds/{number}") >= retention_seconds:
                old.append(number)
        if not old:
            return []
        folds = {n: json.loads(store.read(f"folds/{n}")) for n in numbers}
        folded = Versions.of_json(folds[old[-1]]["versions"])
        removed = [f"version={n}" for n in self.done(spark) if n in folded]
        kept = {item for n in numbers if n >= old[-1] for item in folds[n]["dates"].items()}
        gone = {item for n in old[:-1] for item in folds[n]["dates"].items()} - kept
        removed += [f"folded/window_date={day}/fold={name}" for day, name in sorted(gone)]
        for name in [*removed, *[f"folds/{n}" for n in old[:-1]]]:
            store.delete(name)
        return removed
