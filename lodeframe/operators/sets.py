"""Sets as rows (key, member): algebra, membership, sampling and updates, all without collecting a set into one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def members(sets: DataFrame, key) -> DataFrame:
    return sets.where(F.col("key") == key).select("member").distinct()


def cardinality(sets: DataFrame) -> DataFrame:
    """Exact number of members of each key."""
    return sets.select("key", "member").distinct().groupBy("key").agg(F.count("member").alias("cardinality"))  # rows known to be distinct are not made so again


def union(sets: DataFrame, keys: list) -> DataFrame:
    return sets.where(F.col("key").isin(keys)).select("member").distinct()


def intersection(sets: DataFrame, keys: list) -> DataFrame:
    """Members that every key has; one aggregation however many keys there are. A missing key leaves nothing."""
    n = len(set(keys))
    found = sets.where(F.col("key").isin(keys)).groupBy("member").agg(F.count_distinct("key").alias("n"))
    return found.where(F.col("n") == n).select("member")


def intersection_cardinality(sets: DataFrame, keys: list, limit: int = 0) -> DataFrame:
    """Number of common members, counted up to `limit` (0: all)."""
    found = intersection(sets, keys)
    return (found.limit(limit) if limit else found).agg(F.count("*").alias("cardinality"))


def difference(sets: DataFrame, first, rest: list) -> DataFrame:
    """Members of `first` that none of `rest` has."""
    others = sets.where(F.col("key").isin(rest)).select("member")
    return members(sets, first).join(others, "member", "left_anti")


def is_member(sets: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (key, member, more): those that are members."""
    return probes.join(sets.select("key", "member"), ["key", "member"], "left_semi")


def membership(sets: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (key, member, more) with a boolean for each."""
    known = sets.select("key", "member").distinct().withColumn("_in", F.lit(True))
    return probes.join(known, ["key", "member"], "left").withColumn("is_member", F.coalesce("_in", F.lit(False))).drop("_in")


def add(sets: DataFrame, more: DataFrame) -> DataFrame:
    return sets.select("key", "member").unionByName(more.select("key", "member")).distinct()


def added(sets: DataFrame, more: DataFrame) -> DataFrame:
    """How many of the rows added to each key were new."""
    return more.select("key", "member").distinct().join(sets, ["key", "member"], "left_anti").groupBy("key").agg(F.count("*").alias("added"))


def remove(sets: DataFrame, gone: DataFrame) -> DataFrame:
    return sets.join(gone.select("key", "member"), ["key", "member"], "left_anti")


def move(sets: DataFrame, source, target, member: Column) -> DataFrame:
    """Members for which `member` holds go from source to target; those that target has already stay once."""
    here = (F.col("key") == source) & member
    return sets.withColumn("key", F.when(here, F.lit(target)).otherwise(F.col("key"))).distinct()


def draw_order(seed: str) -> Column:
    """A reproducible random order of members."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("member").cast("string")).cast("binary"))


def sample(sets: DataFrame, n: int, seed: str) -> DataFrame:
    """n members of each key, without repeats."""
    w = Window.partitionBy("key").orderBy(draw_order(seed), "member")
    return sets.distinct().withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def sample_with_repeats(sets: DataFrame, n: int, seed: str) -> DataFrame:
    """(key, draw, member): n draws of each key with repeats, each by a hash of seed, key and draw."""
    place = sets.withColumn("_i", F.row_number().over(Window.partitionBy("key").orderBy("member")) - 1)
    sizes = sets.groupBy("key").agg(F.count("*").alias("_n")).withColumn("draw", F.explode(F.array(*[F.lit(i) for i in range(n)])))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("key").cast("string"), F.col("draw").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return sizes.withColumn("_i", h % F.col("_n")).join(place, ["key", "_i"]).select("key", "draw", "member")


def pop(sets: DataFrame, n: int, seed: str) -> DataFrame:
    """What is left once n drawn members of each key are gone. These are hashed, as sorting them would sort the whole sets."""
    return remove(sets.distinct(), sample(sets, n, seed).hint("shuffle_hash"))


def scan(sets: DataFrame, pattern: str) -> DataFrame:
    """Members that match a glob pattern."""
    from lodeframe.functions.glob import matches

    return sets.where(matches(F.col("member").cast("string"), pattern))


def store(result: DataFrame, key) -> DataFrame:
    """A result of this module as the rows of a key."""
    return result.select(F.lit(key).alias("key"), "member")
