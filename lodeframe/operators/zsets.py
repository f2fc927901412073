"""Sorted sets as rows (key, member, score), ordered by (score, member): ranks, ranges, weighted algebra, updates.

Windows are partitioned by key throughout. A range over one key whose end is not counted from the tail is an
ordered limit instead, so no single task sorts it all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_key(descending: bool = False):
    order = [F.col("score").desc(), F.col("member").desc()] if descending else [F.col("score"), F.col("member")]
    return Window.partitionBy("key").orderBy(*order)


def rank(z: DataFrame, descending: bool = False) -> DataFrame:
    """Adds the rank from 0."""
    return z.withColumn("rank", (F.row_number().over(_by_key(descending)) - 1).cast("long"))


def by_rank(z: DataFrame, start: int, stop: int, descending: bool = False) -> DataFrame:
    """Rows of each key whose rank lies in [start, stop], negative ones counted from the end; adds the rank."""
    ranked = rank(z, descending)
    if start >= 0 and stop >= 0:
        return ranked.where(F.col("rank").between(start, stop))
    n = F.count("*").over(Window.partitionBy("key"))
    at = lambda i: F.lit(i) if i >= 0 else F.col("_n") + i
    return ranked.withColumn("_n", n).where((F.col("rank") >= at(start)) & (F.col("rank") <= at(stop))).drop("_n")


def score_between(low: float | None = None, high: float | None = None, low_open: bool = False, high_open: bool = False) -> Column:
    """A predicate on score; None is unbounded. Open bounds are strict."""
    out = F.lit(True)
    if low is not None:
        out = out & ((F.col("score") > low) if low_open else (F.col("score") >= low))
    if high is not None:
        out = out & ((F.col("score") < high) if high_open else (F.col("score") <= high))
    return out


def member_between(low: str = "-", high: str = "+") -> Column:
    """A predicate on member in byte order: "-" and "+" are unbounded, "[x" includes x, "(x" does not."""
    member, out = F.col("member").cast("string"), F.lit(True)
    if low == "+" or high == "-":
        return F.lit(False)
    if low != "-":
        out = out & ((member >= low[1:]) if low[0] == "[" else (member > low[1:]))
    if high != "+":
        out = out & ((member <= high[1:]) if high[0] == "[" else (member < high[1:]))
    return out


def by_score(z: DataFrame, where: Column, offset: int = 0, count: int | None = None, descending: bool = False) -> DataFrame:
    """Rows of each key within a score range; with a limit per key."""
    found = z.where(where)
    if not offset and count is None:
        return found
    r = F.row_number().over(_by_key(descending))
    last = offset + count if count is not None else None
    found = found.withColumn("_r", r).where(F.col("_r") > offset)
    return (found if last is None else found.where(F.col("_r") <= last)).drop("_r")


def count(z: DataFrame, where: Column) -> DataFrame:
    return z.groupBy("key").agg(F.count_if(where).alias("n"))


def scores(z: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (pos, key, member) with their scores, null where there is none."""
    return probes.join(z.select("key", "member", "score"), ["key", "member"], "left")


def pop(z: DataFrame, n: int, descending: bool = False) -> DataFrame:
    """The n lowest (highest) rows of each key."""
    return rank(z, descending).where(F.col("rank") < n).drop("rank")


def upsert(z: DataFrame, more: DataFrame, keep: str = "last") -> DataFrame:
    """z with rows of more (key, member, score, seq) put in: the last one wins, or the greatest ("gt") or least ("lt")
    score; "nx" only adds members, "xx" only changes them."""
    old = z.select("key", "member", "score", F.lit(None).cast("long").alias("seq"))
    new = more.select("key", "member", "score", F.col("seq").cast("long"))
    if keep == "nx":
        new = new.join(z, ["key", "member"], "left_anti")
    if keep == "xx":
        new = new.join(z, ["key", "member"], "left_semi")
    best = {"gt": F.max("score"), "lt": F.min("score")}.get(keep, F.max_by("score", F.coalesce("seq", F.lit(-1))))
    return old.unionByName(new).groupBy("key", "member").agg(best.alias("score"))


def increment(z: DataFrame, deltas: DataFrame) -> DataFrame:
    """deltas (key, member, score) added to the scores; members that are missing start from 0."""
    return z.select("key", "member", "score").unionByName(deltas.select("key", "member", "score")).groupBy("key", "member").agg(F.sum("score").alias("score"))


def _weighted(z: DataFrame, weights: dict) -> DataFrame:
    w = F.lit(None).cast("double")
    for k, v in weights.items():
        w = F.when(F.col("key") == k, F.lit(float(v))).otherwise(w)
    return z.where(F.col("key").isin(list(weights))).select("key", "member", (F.col("score") * w).alias("score"))


_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def union(z: DataFrame, weights: dict, aggregate: str = "sum") -> DataFrame:
    """(member, score) of the members of any key: scores times their key's weight, combined."""
    return _weighted(z, weights).groupBy("member").agg(_COMBINE[aggregate]("score").alias("score"))


def intersection(z: DataFrame, weights: dict, aggregate: str = "sum") -> DataFrame:
    """The same for members of all keys, in one aggregation."""
    found = _weighted(z, weights).groupBy("member").agg(_COMBINE[aggregate]("score").alias("score"), F.count_distinct("key").alias("_n"))
    return found.where(F.col("_n") == len(weights)).drop("_n")


def difference(z: DataFrame, first, rest: list) -> DataFrame:
    """(member, score) of the first key's members that no other key has."""
    others = z.where(F.col("key").isin(rest)).select("member")
    return z.where(F.col("key") == first).select("member", "score").join(others, "member", "left_anti")


def remove(z: DataFrame, where: Column) -> DataFrame:
    return z.where(~F.coalesce(where, F.lit(False)))


def remove_by_rank(z: DataFrame, start: int, stop: int) -> DataFrame:
    gone = by_rank(z, start, stop).select("key", "member")
    return z.join(gone, ["key", "member"], "left_anti")
