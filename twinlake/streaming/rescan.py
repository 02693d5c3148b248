"""Incremental rescans with Structured Streaming: micro-batches of a listing merge into catalog versions.

A rescan must give what a full scan gives; merging is idempotent by path, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import catalog


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def rescan(listing: DataFrame, store: str, work: str, read: Callable[[int], DataFrame | None], trigger: dict | None = None) -> StreamingQuery:
    """Merges every batch of a listing into the catalog below ``store``: batch n writes version n + 1 from version n.

    ``read`` gives a version (None before the first); offsets and commits are kept in ``work``."""

    def step(batch: DataFrame, n: int) -> None:
        before = read(n)
        after = batch.withColumn("file_exists", F.lit(True)) if before is None else catalog.merge(before, batch)
        after.write.mode("overwrite").parquet(f"{store}/v={n + 1}")

    return listing.writeStream.foreachBatch(step).option("checkpointLocation", work).trigger(**(trigger or {"availableNow": True})).start()


def pending(listing: DataFrame, features: DataFrame, poison: DataFrame) -> DataFrame:
    """Entries whose features must be computed: not cached for this size and date, and not known to crash."""
    return listing.join(features.select("path", "size", "date_modified"), ["path", "size", "date_modified"], "left_anti").join(poison.select("path"), "path", "left_anti")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and kind; the watermark bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def smoothed_rate(samples: Column, share: float = 0.5) -> Column:
    """Exponential smoothing of an array of rates in time order, starting at the first."""
    return F.aggregate(F.slice(samples, 2, F.greatest(F.size(samples) - 1, F.lit(0))), F.get(samples, F.lit(0)).cast("double"), lambda s, x: s * (1 - share) + x * share)


class Progress(StreamingQueryListener):
    """Rows and rate of every batch, with the time left for a known total."""

    def __init__(self, total: int, report: Callable[[dict], None]) -> None:
        self.total, self.report, self.done, self.elapsed = total, report, 0, 0.0

    def onQueryStarted(self, event) -> None:
        self.done, self.elapsed = 0, 0.0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.done += p.numInputRows
        self.elapsed += p.batchDuration / 1000
        self.report({"done": self.done, "rows_a_second": p.processedRowsPerSecond, "seconds_left": max(0.0, self.elapsed * (self.total - self.done) / (self.done + 1))})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report({"done": self.done, "ended": True})
