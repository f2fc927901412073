"""Keys with an expiry: views, expiry rules, patterns, renames, and sorting by looked-up values. Rows are
(key, value, expire_at, more), expire_at in epoch milliseconds or null. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.glob import matches


def live(table: DataFrame, now: int) -> DataFrame:
    """Rows that have not expired; one that expires now has."""
    return table.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))


def ttl(now: int, unit: int = 1) -> Column:
    """Time left in milliseconds, or in seconds with a unit of 1000; -1 without expiry."""
    left = F.expr(f"(expire_at - {int(now)}) DIV {int(unit)}")
    return F.when(F.col("expire_at").isNull(), F.lit(-1).cast("long")).otherwise(left)


def ttl_of(table: DataFrame, probes: DataFrame, now: int, unit: int = 1) -> DataFrame:
    """probes (key): time left, -1 without expiry, -2 without such a key."""
    seen = live(table, now).select("key", ttl(now, unit).alias("ttl"))
    return probes.join(seen, "key", "left").withColumn("ttl", F.coalesce("ttl", F.lit(-2).cast("long")))


def expire(table: DataFrame, at: Column, when: str = "") -> DataFrame:
    """Sets expire_at; NX only without one, XX only with one, GT only later, LT only sooner (none counts as never)."""
    old = F.col("expire_at")
    test = {"": F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (at > old), "LT": old.isNull() | (at < old)}[when.upper()]
    return table.withColumn("expire_at", F.when(test, at).otherwise(old))


def persist(table: DataFrame) -> DataFrame:
    return table.withColumn("expire_at", F.lit(None).cast("long"))


def keys(table: DataFrame, pattern: str) -> DataFrame:
    return table.where(matches(F.col("key"), pattern)).select("key")


def exists(table: DataFrame, probes: DataFrame) -> DataFrame:
    """How many probes have a key; repeats count."""
    return probes.join(table.select("key"), "key", "left_semi").agg(F.count("*").alias("n"))


def delete(table: DataFrame, probes: DataFrame) -> DataFrame:
    return table.join(probes.select("key"), "key", "left_anti")


def rename(table: DataFrame, old: str, new: str, if_absent: bool = False) -> DataFrame:
    """old becomes new, whose former rows go; with if_absent nothing changes where new is there already."""
    moved = F.when(F.col("key") == old, F.lit(new)).otherwise(F.col("key"))
    facts = F.broadcast(table.agg(F.coalesce(F.bool_or(F.col("key") == old), F.lit(False)).alias("_old"), F.coalesce(F.bool_or(F.col("key") == new), F.lit(False)).alias("_new")))
    go = F.col("_old") & ~F.col("_new") if if_absent else F.col("_old")
    both = table.join(facts, F.lit(True))
    kept = both.where(~(go & (F.col("key") == new) & F.lit(old != new)))
    return kept.withColumn("key", F.when(go, moved).otherwise(F.col("key"))).drop("_old", "_new")


def copy(table: DataFrame, old: str, new: str, replace: bool = False) -> DataFrame:
    there = table.where(F.col("key") == new)
    rows = table.where(F.col("key") == old).withColumn("key", F.lit(new))
    if replace:
        return table.where(F.col("key") != new).unionByName(rows)
    clash = F.broadcast(there.agg((F.count("*") > 0).alias("_clash")))  # one row
    return table.unionByName(rows.join(clash, ~F.col("_clash")).drop("_clash"))


def dump(table: DataFrame) -> DataFrame:
    """(key, dump): all other columns as JSON."""
    return table.select("key", F.to_json(F.struct(*[c for c in table.columns if c != "key"])).alias("dump"))


def restore(dumped: DataFrame, schema: str) -> DataFrame:
    return dumped.select("key", F.from_json("dump", schema).alias("_x")).select("key", "_x.*")


def random_key(table: DataFrame, seed: str) -> DataFrame:
    return table.select("key").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("key")).cast("binary")), "key").limit(1)


def sort_by(elements: DataFrame, lookup: DataFrame | None, by: Column | None, get: dict[str, tuple[DataFrame, Column]] | None = None,
            alpha: bool = False, descending: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """elements (elem) in the order of looked-up weights.

    by: the key to look up in lookup (key, value) for each element; None sorts by the element itself. get: columns
    to add, each a lookup of its own. Weights are compared as bytes if alpha, else as numbers; missing ones are null,
    which come first. Ties go by element.
    """
    rows = elements
    if by is None:
        rows = rows.withColumn("_w", F.col("elem").cast("string"))
    else:
        rows = rows.withColumn("_k", by).join(lookup.select(F.col("key").alias("_k"), F.col("value").alias("_w")), "_k", "left").drop("_k")
    for name, (table, key) in (get or {}).items():
        rows = rows.withColumn("_k", key).join(table.select(F.col("key").alias("_k"), F.col("value").alias(name)), "_k", "left").drop("_k")
    w = F.col("_w") if alpha else F.col("_w").cast("double")
    rows = rows.orderBy(w.desc_nulls_last(), F.col("elem").desc()) if descending else rows.orderBy(w.asc_nulls_first(), "elem")
    rows = rows.offset(offset) if offset else rows
    return (rows.limit(count) if count is not None else rows).drop("_w")
