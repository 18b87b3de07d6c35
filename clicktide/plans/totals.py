"""Totals per campaign that are kept up to date write by write, instead of added up at every read.

For each new write of the table only the keys it may have changed are looked at: the value before is
taken back from the campaign's total and the new one added. So a refresh reads the date folders that
the new writes have, from their first window on, and one row per campaign; no older date. A file in
``totals`` says which writes the totals hold, so any order of writers, a write that gets done late
and a refresh that is lost half-way are all the same. Of two refreshes at a time one counts.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktide.contracts import AGG_KEYS
from clicktide.functions.store import Store
from clicktide.operators.table import CampaignTable, Versions

TOTALS_SCHEMA = "campaign_id string, clicks long, unique_users long"
_SUMS = ("clicks", "unique_users")
# Seconds that totals which newer ones have replaced stay for readers.
KEPT_SECONDS = 3600.0


@dataclass(frozen=True)
class CampaignTotals:
    table: CampaignTable

    def read(self, spark: SparkSession) -> DataFrame:
        """Clicks and users per campaign, as of the last refresh; no order."""
        _, _, folder = self._last(spark)
        if not folder:
            return spark.createDataFrame([], TOTALS_SCHEMA)
        return spark.read.schema(TOTALS_SCHEMA).parquet(f"{self.table.root}/{folder}")

    def held(self, spark: SparkSession) -> Versions:
        """The writes that the totals hold."""
        return self._last(spark)[1]

    def refresh(self, spark: SparkSession) -> bool:
        """Bring the totals up to the last write that is done; says whether there was anything new."""
        number, held, folder = self._last(spark)
        fold, done = self.table.last_fold(spark), self.table.done(spark)
        if not folder or not fold.versions.within(held):
            # A fold has lost what was before writes that the totals don't hold: add all up.
            held, wanted = Versions(), fold.versions.and_also(done)
            made = self._changes(spark, held, wanted, None)
        else:
            new = [n for n in done if n not in held]
            if not new:
                return False
            wanted = held.and_also(new)
            days = self.table.dates_of(spark, new)
            changes = self._changes(spark, held, wanted, days)
            made = changes.unionByName(self.read(spark)) if days else None
        if made is not None:
            folder = f"totals-data/{uuid.uuid4().hex}"
            sums = made.groupBy("campaign_id").agg(*[F.sum(name).alias(name) for name in _SUMS])
            sums.write.parquet(f"{self.table.root}/{folder}")
        store = Store(spark, self.table.root)
        text = json.dumps({"versions": wanted.as_json(), "folder": folder})
        if not store.create(f"totals/{number + 1}", text):
            return False
        self._clean(store, number + 1)
        return True

    def changes(self, spark: SparkSession) -> DataFrame:
        """What the next refresh will add to the totals, per campaign."""
        _, held, _ = self._last(spark)
        new = [n for n in self.table.done(spark) if n not in held]
        return self._changes(spark, held, held.and_also(new), self.table.dates_of(spark, new))

    def _changes(
        self, spark: SparkSession, held: Versions, wanted: Versions, days: set[date] | None
    ) -> DataFrame:
        """Per campaign the new values less the old ones, over the keys of these days."""
        version = F.col("version")
        rows = self.table.changelog(spark, days).where(wanted.condition(version))
        was = held.condition(version)
        if days is not None:
            first = rows.where(~was).agg(F.min("window_end").alias("window_end"))
            rows = rows.where(F.col("window_end") >= first.scalar())
        values = [F.max_by(name, "version").alias(name) for name in _SUMS]
        before = [
            F.coalesce(F.max_by(name, F.when(was, version)), F.lit(0)).alias(f"old_{name}")
            for name in _SUMS
        ]
        keys = rows.groupBy(*AGG_KEYS).agg(*values, *before)
        return keys.groupBy("campaign_id").agg(
            *[F.sum(F.col(name) - F.col(f"old_{name}")).alias(name) for name in _SUMS]
        )

    def compact(self, spark: SparkSession) -> list[date]:
        """Fold what the totals hold, after a refresh; so the next refresh is a small one too."""
        self.refresh(spark)
        return self.table.compact(spark, within=self.held(spark))

    def _last(self, spark: SparkSession) -> tuple[int, Versions, str | None]:
        store = Store(spark, self.table.root)
        number = max((int(path.split("/")[1]) for path in store.paths("totals/*")), default=None)
        if number is None:
            return -1, Versions(), None
        found = json.loads(store.read(f"totals/{number}"))
        return number, Versions.of_json(found["versions"]), found["folder"]

    def _clean(self, store: Store, last: int) -> None:
        """Delete totals that readers have had time to finish with."""
        folders = {}
        for path in store.paths("totals/*"):
            number = int(path.split("/")[1])
            old = number < last and time.time() - store.seconds(path) > KEPT_SECONDS
            folders.setdefault(json.loads(store.read(path))["folder"], []).append((path, old))
        for folder, files in folders.items():
            if folder and all(old for _, old in files):
                store.delete(folder)
            for path, old in files:
                if old:
                    store.delete(path)
