"""The ledger as a stream: event files as they arrive, each event once, activity by window, batches into a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.paths import parse_time
from lodegraph.model import EVENTS


def read_events(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """New lines of JSONL files below ``path``, with ``at``; lines that aren't events are left out."""
    raw = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_each).json(path)
    return raw.where("id is not null").withColumn("at", parse_time(F.col("ts")))


def once_each(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without repeats of an id that come within ``late``; state is kept no longer than that."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


def activity(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, kind, n_events by window."""
    counts = events.withWatermark("at", late).groupBy(F.window("at", window), "kind").agg(F.count(F.lit(1)).alias("n_events"))
    return counts.select(F.col("window.start").alias("start"), "kind", "n_events")


def into(events: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Start a query that gives each batch to ``handle``, at least once; a handler that upserts by key makes that exactly once."""
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
