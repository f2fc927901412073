"""Time series as rows (key, ts_ms, value) with a table of labels (key, labels map): ranges, buckets, duplicates, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Aggregators over the samples of a bucket. The sample forms give 0 for fewer than two samples.
AGGREGATORS = {
    "avg": lambda: F.avg("value"),
    "twa": lambda: F.avg("value"),
    "sum": lambda: F.sum("value"),
    "min": lambda: F.min("value"),
    "max": lambda: F.max("value"),
    "count": lambda: F.count("value").cast("double"),
    "first": lambda: F.min_by("value", "ts_ms"),
    "last": lambda: F.max_by("value", "ts_ms"),
    "range": lambda: F.max("value") - F.min("value"),
    "stdp": lambda: F.stddev_pop("value"),
    "stds": lambda: F.coalesce(F.stddev_samp("value"), F.lit(0.0)),
    "varp": lambda: F.var_pop("value"),
    "vars": lambda: F.coalesce(F.var_samp("value"), F.lit(0.0)),
}


def bucket(ms: int, ts: str = "ts_ms") -> Column:
    """Start of the bucket of `ms` milliseconds that a time lies in, floored."""
    return F.col(ts) - F.pmod(F.col(ts), F.lit(ms))


def range_(samples: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Samples from start to stop, both included."""
    if start is not None:
        samples = samples.where(F.col("ts_ms") >= start)
    return samples if stop is None else samples.where(F.col("ts_ms") <= stop)


def aggregate(samples: DataFrame, ms: int, kind: str) -> DataFrame:
    """(key, ts_ms, value): a value for each bucket that has samples, labelled with its start."""
    out = samples.groupBy("key", bucket(ms).alias("_b")).agg(AGGREGATORS[kind]().alias("value"))
    return out.select("key", F.col("_b").alias("ts_ms"), "value")


def time_weighted(samples: DataFrame, ms: int) -> DataFrame:
    """A true time-weighted average per bucket: each sample counts until the next of its key, within its bucket."""
    b = bucket(ms)
    nxt = F.least(F.coalesce(F.lead("ts_ms").over(Window.partitionBy("key").orderBy("ts_ms")), b + ms), b + ms)
    held = samples.withColumn("_d", (nxt - F.col("ts_ms")).cast("double"))
    out = held.groupBy("key", b.alias("_b")).agg((F.sum(F.col("value") * F.col("_d")) / F.sum("_d")).alias("value"))
    return out.select("key", F.col("_b").alias("ts_ms"), "value")


def first_per_key(samples: DataFrame, count: int, descending: bool = False) -> DataFrame:
    """The first (last) `count` rows of each key."""
    order = F.col("ts_ms").desc() if descending else F.col("ts_ms")
    return samples.withColumn("_i", F.row_number().over(Window.partitionBy("key").orderBy(order))).where(F.col("_i") <= count).drop("_i")


def latest(samples: DataFrame) -> DataFrame:
    return samples.groupBy("key").agg(F.max("ts_ms").alias("ts_ms"), F.max_by("value", "ts_ms").alias("value"))


def matching(meta: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Keys whose labels have all these values."""
    where = F.lit(True)
    for k, v in labels.items():
        where = where & (F.col("labels")[k] == v)
    return meta.where(where).select("key")


def of_matching(samples: DataFrame, meta: DataFrame, labels: dict[str, str]) -> DataFrame:
    return samples.join(matching(meta, labels), "key", "left_semi")


def resolve(samples: DataFrame, policy: str) -> DataFrame:
    """One value for each (key, ts_ms) of samples (key, ts_ms, value, seq): first, last, min, max, sum; "block" raises."""
    if policy == "block":
        n = F.count("*")
        value = F.when(n > 1, F.raise_error(F.lit("duplicate timestamp"))).otherwise(F.max("value"))
    else:
        value = {"first": F.min_by("value", "seq"), "last": F.max_by("value", "seq"), "min": F.min("value"), "max": F.max("value"), "sum": F.sum("value")}[policy]
    return samples.groupBy("key", "ts_ms").agg(value.alias("value"))


def delete(samples: DataFrame, start: int, stop: int) -> DataFrame:
    return samples.where(~F.col("ts_ms").between(start, stop))


def retain(samples: DataFrame, ms: int) -> DataFrame:
    """Samples no older than `ms` before the latest of their key."""
    ends = samples.groupBy("key").agg((F.max("ts_ms") - ms).alias("_cut"))
    return samples.join(ends, "key").where(F.col("ts_ms") >= F.col("_cut")).drop("_cut")


def increment(changes: DataFrame) -> DataFrame:
    """(key, ts_ms, value) as changes: each sample is the last one plus its change."""
    w = Window.partitionBy("key").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("value", F.sum("value").over(w))


def info(samples: DataFrame) -> DataFrame:
    return samples.groupBy("key").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def rollup(samples: DataFrame, ms: int, kinds: list[str]) -> DataFrame:
    """Several aggregators per bucket in one pass: what a set of down-sampling rules gives."""
    out = samples.groupBy("key", bucket(ms).alias("_b")).agg(*[AGGREGATORS[k]().alias(k) for k in kinds])
    return out.withColumnRenamed("_b", "ts_ms")


def reduce_groups(samples: DataFrame, meta: DataFrame, label: str, ms: int, kind: str) -> DataFrame:
    """Series of one label value reduced to one series: (group, ts_ms, value)."""
    named = samples.join(meta.select("key", F.col("labels")[label].alias("_g")), "key").select(F.col("_g").alias("key"), "ts_ms", "value")
    return aggregate(named, ms, kind).withColumnRenamed("key", "group")


# Series as rows (key, labels map, retention_ms, duplicates).
DUPLICATES = ("block", "first", "last", "min", "max", "sum")


def create(series: DataFrame, more: DataFrame) -> DataFrame:
    """series with those of more that are not there yet."""
    return series.unionByName(more.select(series.columns).join(series.select("key"), "key", "left_anti"))


def alter(series: DataFrame, changes: DataFrame) -> DataFrame:
    """series with the values of changes (same columns), of which nulls change nothing."""
    new = changes.select("key", *[F.col(c).alias(f"_{c}") for c in series.columns if c != "key"])
    return series.join(new, "key", "left").select(*[F.col(c) if c == "key" else F.coalesce(f"_{c}", c).alias(c) for c in series.columns])


def delete_rules(rules: DataFrame, gone: DataFrame) -> DataFrame:
    """rules (source, target, ms, kind) without those from one series to another."""
    return rules.join(gone.select("source", "target"), ["source", "target"], "left_anti")


def retain_each(samples: DataFrame, series: DataFrame) -> DataFrame:
    """Samples within the retention of their series, counted from its latest; all where it is null or 0."""
    ends = samples.groupBy("key").agg(F.max("ts_ms").alias("_end")).join(series.select("key", "retention_ms"), "key", "left")
    ends = ends.select("key", F.when(F.col("retention_ms") > 0, F.col("_end") - F.col("retention_ms")).alias("_cut"))
    return samples.join(ends, "key").where(F.col("_cut").isNull() | (F.col("ts_ms") >= F.col("_cut"))).drop("_cut")
