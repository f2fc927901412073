"""Sources and sinks: snapshots as Parquet, streams of files, and views with an expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save(table: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A snapshot. Sorting within files gives narrow statistics, which later range reads prune by."""
    if sort_by:
        table = table.sortWithinPartitions(*sort_by)
    w = table.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def tail(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A streaming DataFrame of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def store(table: DataFrame, name: str, bucket_by: list[str] | None = None, buckets: int = 64) -> None:
    """A named table, bucketed if later joins are on those columns."""
    w = table.write.mode("overwrite").format("parquet")
    (w.bucketBy(buckets, *bucket_by).sortBy(*bucket_by) if bucket_by else w).saveAsTable(name)
