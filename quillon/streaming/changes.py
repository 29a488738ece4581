"""Streams of change events: the latest event of each key decides, upserts and deletes follow per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# What an event's action does.
UPSERT = ("opened", "edited", "reopened", "synchronize", "commented")
DELETE = ("closed", "deleted")


def latest(events: DataFrame, key: str = "path", time: str = "updated_at") -> DataFrame:
    """The last event of each key; of equal times, the larger event id."""
    order = Window.partitionBy(key).orderBy(F.desc(time), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest events that write and that delete; comments on closed items write nothing."""
    last = latest(events)
    return last.filter(F.col("action").isin(*UPSERT) & (F.coalesce("state", F.lit("open")) == "open")), last.filter(F.col("action").isin(*DELETE))


def apply_changes(stream: DataFrame, write: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run write(upserts, deletes, batch) for every micro-batch; without `every`, once over what is there."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: write(*split(batch), n))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts of events by type in tumbling windows, with a watermark; an extra of Spark's own."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
