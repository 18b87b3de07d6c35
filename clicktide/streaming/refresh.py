"""Keeping the serving views up to date while the stream runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clicktide.operators.table import CampaignTable
from clicktide.plans.serving import register_views
from clicktide.plans.totals import CampaignTotals

# Fixed value: seconds a served result stays valid.
SERVING_TTL = 5.0
# Views name files; they are renewed long before a vacuum may delete those.
RENEWED_SECONDS = 600.0


class ServingRefresh:
    """Renews the views after a batch, at most once per ``ttl`` seconds, and by the clock.

    To be passed as ``then`` to ``table_sink``, and ``by_clock`` as ``idle`` to ``finish_all``. The
    views belong to ``spark``, not to the stream's own copy of the session. Totals per campaign are
    kept from batch to batch; only what the batch has changed is read.
    """

    def __init__(
        self,
        spark: SparkSession,
        table: CampaignTable,
        prefix: str = "",
        ttl: float = SERVING_TTL,
        clock: Callable[[], float] = time.monotonic,
        renewed_seconds: float = RENEWED_SECONDS,
    ) -> None:
        self._spark, self._table, self._prefix = spark, table, prefix
        self._ttl, self._clock, self._renewed_seconds = ttl, clock, renewed_seconds
        self._totals = CampaignTotals(table)
        self._renewed: float | None = None

    def __call__(self, batch: DataFrame | None = None, batch_id: int | None = None) -> bool:
        return self._renew(self._ttl)

    def by_clock(self) -> bool:
        """Renew views that no batch has renewed for some time, so that a fold can't outlive them."""
        return self._renew(self._renewed_seconds)

    def _renew(self, seconds: float) -> bool:
        now = self._clock()
        if self._renewed is not None and now - self._renewed < seconds:
            return False
        self._totals.refresh(self._spark)
        register_views(self._spark, self._table, self._prefix, self._totals.read(self._spark))
        self._renewed = now
        return True
