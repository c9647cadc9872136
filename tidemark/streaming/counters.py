"""Counters of a stream that can be read while it runs, without another pass over what it wrote."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "moved"


def counted(rows: DataFrame, **sums: Column) -> DataFrame:
    """The same stream, with the number of its rows and some sums taken on the way to the sink."""
    totals = [F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name) for name, value in sums.items()]
    return rows.observe(METRICS, F.count(F.lit(1)).alias("files"), *totals)


class Counters(StreamingQueryListener):
    """Adds up what ``counted`` saw, batch by batch, for each stream that reports to it.

    A batch that is run again after a failure counts once: what is known of it is replaced. Register it with
    ``spark.streams.addListener``; ``totals`` may be read at any time.
    """

    def __init__(self):
        self._lock, self._batches = Lock(), {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(METRICS)
        if row is not None:
            with self._lock:
                self._batches[str(progress.id), progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self, query_id: str | None = None) -> dict[str, int]:
        """Sums over the batches so far, of one stream or of all."""
        with self._lock:
            rows = [row for (query, _), row in self._batches.items() if query_id in (None, query)]
        return {name: sum(row[name] for row in rows) for name in (rows[0] if rows else {})}
