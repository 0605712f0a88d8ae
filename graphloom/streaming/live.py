"""Live refresh: a change feed, debounced by session windows, applied to the facts in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounce(events: DataFrame, gap: str = "700 milliseconds", key: str = "user_id", at: str = "ts", late: str | None = None) -> DataFrame:
    """Bursts of changes: `started`, `ended`, `changes` of each run of events with no gap of `gap` between them.

    Works on a table and on a stream; on a stream `late` is the watermark, and a burst is emitted once it has passed.
    Events later than that change nothing here, which is safe: the next refresh compares contents, not events.
    """
    source = events.withWatermark(at, late) if late else events
    out = source.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("changes"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes")


def change_feed(spark: SparkSession, folder: str, schema: str, max_files: int = 1000) -> DataFrame:
    """A stream of change events written as JSON files below `folder`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def refresh_on(changes: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run `refresh` on each micro-batch of changed paths. One query is one writer: bursts that come meanwhile are one batch."""
    writer = changes.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_facts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The facts after a batch: rows of changed keys are replaced, others stay. A row of `new` with `deleted` goes."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new.where(~F.coalesce(F.col("deleted"), F.lit(False))).drop("deleted"))
