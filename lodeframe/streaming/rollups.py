"""Live forms of the batch operators on streaming DataFrames; each also works on a batch one where that makes sense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(events: DataFrame, ts: str, key: str, value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Windows of a key's values; rows later than `late` behind the newest are dropped. With a slide windows overlap."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(F.col(key).alias("key"), w.alias("w"))
    out = out.agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "sum", "min", "max", "avg")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.col(key).alias("key"), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Each key once within the lateness bound."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def published(events: DataFrame, channel: str, pattern: str) -> DataFrame:
    """Messages of the channels that a glob pattern matches."""
    from lodeframe.functions.glob import matches

    return events.where(matches(F.col(channel), pattern))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What a key-space feed would tell between two states: (key, event) of set, change and del."""
    a = old.select(key, F.xxhash64(*[c for c in old.columns if c != key]).alias("_a"))
    b = new.select(key, F.xxhash64(*[c for c in new.columns if c != key]).alias("_b"))
    event: Column = F.when(F.col("_a").isNull(), "set").when(F.col("_b").isNull(), "del").when(F.col("_a") != F.col("_b"), "change")
    return a.join(b, key, "full").select(key, event.alias("event")).where("event IS NOT NULL")


def publish(events: DataFrame, channel: str, pattern: str, sink: str, checkpoint: str):
    """A running query that appends each batch's messages of matching channels to a Parquet sink, partitioned by channel. A batch
    that is tried again replaces its own files, so each message is there once."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(channel).parquet(f"{sink}/batch={batch_id}")

    return published(events, channel, pattern).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
