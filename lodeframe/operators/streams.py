"""Append-only streams as rows (key, ms, seq, more), ids being (ms, seq); and consumer groups as tables
groups (key, group, ms, seq) and pending (key, group, ms, seq, consumer, delivered_ms, deliveries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = ["ms", "seq"]


def _w():
    return Window.partitionBy("key")


def id_of(ms: str = "ms", seq: str = "seq") -> Column:
    return F.struct(F.col(ms), F.col(seq))


def _lit(i: tuple[int, int]) -> Column:
    return F.struct(F.lit(i[0]).cast("long"), F.lit(i[1]).cast("long"))


def after(i: tuple[int, int]) -> Column:
    """id > i, as bounds that Parquet can use."""
    return (F.col("ms") > i[0]) | ((F.col("ms") == i[0]) & (F.col("seq") > i[1]))


def between(low: tuple[int, int], high: tuple[int, int]) -> Column:
    left = (F.col("ms") > low[0]) | ((F.col("ms") == low[0]) & (F.col("seq") >= low[1]))
    right = (F.col("ms") < high[0]) | ((F.col("ms") == high[0]) & (F.col("seq") <= high[1]))
    return F.col("ms").between(low[0], high[0]) & left & right


def append(stream: DataFrame, more: DataFrame) -> DataFrame:
    """more put in where its ids exceed all of its stream's; others are rejected."""
    tops = stream.groupBy("key").agg(F.max(id_of()).alias("_top"))
    ok = more.join(tops, "key", "left").where(F.col("_top").isNull() | (id_of() > F.col("_top"))).drop("_top")
    return stream.unionByName(ok)


def range_(stream: DataFrame, low: tuple[int, int], high: tuple[int, int], count: int | None = None, descending: bool = False) -> DataFrame:
    """Entries of each stream with ids from low to high, the first (last) `count` of them."""
    found = stream.where(between(low, high))
    if count is None:
        return found
    order = [F.col(c).desc() if descending else F.col(c) for c in ID]
    return found.withColumn("_i", F.row_number().over(_w().orderBy(*order))).where(F.col("_i") <= count).drop("_i")


def read(stream: DataFrame, offsets: DataFrame, count: int) -> DataFrame:
    """offsets (key, last_ms, last_seq): up to `count` entries after each."""
    new = stream.join(offsets, "key").where((F.col("ms") > F.col("last_ms")) | ((F.col("ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq"))))
    return new.drop("last_ms", "last_seq").withColumn("_i", F.row_number().over(_w().orderBy(*ID))).where(F.col("_i") <= count).drop("_i")


def length(stream: DataFrame) -> DataFrame:
    return stream.groupBy("key").agg(F.count("*").alias("length"))


def delete(stream: DataFrame, ids: DataFrame) -> DataFrame:
    return stream.join(ids.select("key", *ID), ["key", *ID], "left_anti")


def trim_to_length(stream: DataFrame, n: int) -> DataFrame:
    """The last n entries of each stream."""
    return stream.withColumn("_i", F.row_number().over(_w().orderBy(F.col("ms").desc(), F.col("seq").desc()))).where(F.col("_i") <= n).drop("_i")


def trim_to_id(stream: DataFrame, low: tuple[int, int]) -> DataFrame:
    return stream.where(~(F.col("ms") < low[0])).where(~((F.col("ms") == low[0]) & (F.col("seq") < low[1])))


def deliver(stream: DataFrame, groups: DataFrame, consumer: Column, count: int, now: int) -> tuple[DataFrame, DataFrame]:
    """New entries for each group, up to `count`: (groups moved on, entries as pending rows)."""
    heads = groups.select("key", "group", F.col("ms").alias("_m"), F.col("seq").alias("_s"))
    new = stream.select("key", *ID).join(heads, "key").where((F.col("ms") > F.col("_m")) | ((F.col("ms") == F.col("_m")) & (F.col("seq") > F.col("_s"))))
    w = Window.partitionBy("key", "group").orderBy(*ID)
    new = new.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= count)
    rows = new.select("key", "group", *ID, consumer.alias("consumer"), F.lit(now).cast("long").alias("delivered_ms"), F.lit(1).cast("long").alias("deliveries"))
    last = rows.groupBy("key", "group").agg(F.max(id_of()).alias("_x"))
    moved = groups.join(last, ["key", "group"], "left").select("key", "group", F.coalesce("_x.ms", "ms").alias("ms"), F.coalesce("_x.seq", "seq").alias("seq"))
    return moved, rows


def acknowledge(pending: DataFrame, acks: DataFrame) -> DataFrame:
    """pending without the rows acks (key, group, ms, seq) name."""
    return pending.join(acks.select("key", "group", *ID), ["key", "group", *ID], "left_anti")


def pending_summary(pending: DataFrame) -> DataFrame:
    """Per group and consumer: how many, the smallest and the largest id."""
    return pending.groupBy("key", "group", "consumer").agg(
        F.count("*").alias("n"), F.min(id_of()).alias("_a"), F.max(id_of()).alias("_b")
    ).select("key", "group", "consumer", "n", F.col("_a.ms").alias("min_ms"), F.col("_a.seq").alias("min_seq"), F.col("_b.ms").alias("max_ms"), F.col("_b.seq").alias("max_seq"))


def pending_detail(pending: DataFrame, now: int, min_idle: int = 0) -> DataFrame:
    return pending.withColumn("idle_ms", F.lit(now) - F.col("delivered_ms")).where(F.col("idle_ms") >= min_idle)


def claim(pending: DataFrame, ids: DataFrame, consumer: str, now: int, min_idle: int) -> DataFrame:
    """Rows that ids names and that have idled long enough go to a consumer, delivered once more."""
    named = ids.select("key", "group", *ID).distinct().withColumn("_named", F.lit(True))
    go = F.coalesce("_named", F.lit(False)) & (F.lit(now) - F.col("delivered_ms") >= min_idle)
    return (
        pending.join(named, ["key", "group", *ID], "left")
        .withColumn("_go", go)
        .withColumn("consumer", F.when(F.col("_go"), consumer).otherwise(F.col("consumer")))
        .withColumn("delivered_ms", F.when(F.col("_go"), F.lit(now)).otherwise(F.col("delivered_ms")))
        .withColumn("deliveries", F.col("deliveries") + F.col("_go").cast("long"))
        .drop("_go", "_named"))


def auto_claim(pending: DataFrame, stream: DataFrame, consumer: str, now: int, min_idle: int, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """Idle rows from an id on, with their new owner; deleted tells entries that the stream no longer has."""
    idle = pending.where(F.lit(now) - F.col("delivered_ms") >= min_idle).where(~(F.col("ms") < start[0])).where(~((F.col("ms") == start[0]) & (F.col("seq") < start[1])))
    there = stream.select("key", *ID).withColumn("_there", F.lit(True))
    out = idle.join(there, ["key", *ID], "left")
    return out.select("key", "group", *ID, F.lit(consumer).alias("consumer"), (F.col("deliveries") + 1).alias("deliveries"), F.col("_there").isNull().alias("deleted"))


def group_info(stream: DataFrame, groups: DataFrame, pending: DataFrame) -> DataFrame:
    """Per group: consumers, pending entries and lag, the entries it has yet to be given."""
    p = pending.groupBy("key", "group").agg(F.count_distinct("consumer").alias("consumers"), F.count("*").alias("pending"))
    heads = groups.select("key", "group", F.col("ms").alias("_m"), F.col("seq").alias("_s"))
    lag = stream.select("key", *ID).join(heads, "key").groupBy("key", "group").agg(
        F.count_if((F.col("ms") > F.col("_m")) | ((F.col("ms") == F.col("_m")) & (F.col("seq") > F.col("_s")))).alias("lag"))
    return groups.select("key", "group").join(p, ["key", "group"], "left").join(lag, ["key", "group"], "left").select(
        "key", "group", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("consumers", "pending", "lag")])


def set_last_id(heads: DataFrame, more: DataFrame) -> DataFrame:
    """heads (key, ms, seq): the last id given out, moved to that of more where it has the key; never behind an entry."""
    to = more.select("key", F.col("ms").alias("_m"), F.col("seq").alias("_s"))
    both = heads.join(to, "key", "left")
    ahead = (F.col("_m") > F.col("ms")) | ((F.col("_m") == F.col("ms")) & (F.col("_s") > F.col("seq")))
    go = F.coalesce(ahead, F.lit(False))
    return both.select("key", F.when(go, F.col("_m")).otherwise(F.col("ms")).alias("ms"), F.when(go, F.col("_s")).otherwise(F.col("seq")).alias("seq"))


def create_groups(groups: DataFrame, more: DataFrame) -> DataFrame:
    """groups with those of more (key, group, ms, seq) that are not there yet."""
    return groups.unionByName(more.select(groups.columns).join(groups.select("key", "group"), ["key", "group"], "left_anti"))


def set_group_ids(groups: DataFrame, more: DataFrame) -> DataFrame:
    """groups that read on from the ids of more, forwards or backwards."""
    to = more.select("key", "group", F.col("ms").alias("_m"), F.col("seq").alias("_s"))
    return groups.join(to, ["key", "group"], "left").select("key", "group", F.coalesce("_m", "ms").alias("ms"), F.coalesce("_s", "seq").alias("seq"))


def destroy_groups(groups: DataFrame, pending: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, pending) without the groups gone (key, group)."""
    return tuple(x.join(gone.select("key", "group"), ["key", "group"], "left_anti") for x in (groups, pending))


def delete_consumer(pending: DataFrame, consumer: str) -> DataFrame:
    """pending without what a consumer holds."""
    return pending.where(F.col("consumer") != consumer)


def consumer_info(pending: DataFrame, now: int) -> DataFrame:
    """Per group and consumer: pending entries, and how long ago it was given one."""
    return pending.groupBy("key", "group", "consumer").agg(F.count("*").alias("pending"), (F.lit(now) - F.max("delivered_ms")).alias("idle_ms"))


def stream_info(stream: DataFrame) -> DataFrame:
    return stream.groupBy("key").agg(F.count("*").alias("length"), F.min(id_of()).alias("_a"), F.max(id_of()).alias("_b")).select(
        "key", "length", F.col("_a.ms").alias("first_ms"), F.col("_b.ms").alias("last_ms"))
