"""Lists as rows (key, pos, value), pos in order from any start. Indexes count from 0, negative ones from the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _w():
    return Window.partitionBy("key")


def indexed(lists: DataFrame) -> DataFrame:
    """Adds index (from 0) and n, the list's length."""
    i = (F.row_number().over(_w().orderBy("pos")) - 1).cast("long")
    return lists.withColumn("index", i).withColumn("n", F.count("*").over(_w()))


def _at(i: int) -> Column:
    return F.lit(i).cast("long") if i >= 0 else F.col("n") + i


def length(lists: DataFrame) -> DataFrame:
    return lists.groupBy("key").agg(F.count("*").alias("length"))


def slice_(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """Elements start..stop, both included; with their index."""
    return indexed(lists).where((F.col("index") >= _at(start)) & (F.col("index") <= _at(stop))).drop("n")


trim = slice_


def element(lists: DataFrame, i: int) -> DataFrame:
    return indexed(lists).where(F.col("index") == _at(i)).select("key", "value")


def set_element(lists: DataFrame, i: int, value: str) -> DataFrame:
    return indexed(lists).withColumn("value", F.when(F.col("index") == _at(i), value).otherwise(F.col("value"))).select("key", "pos", "value")


def push(lists: DataFrame, more: DataFrame, left: bool = False) -> DataFrame:
    """more (key, seq, value) put at the end, or one after the other at the front, of their lists."""
    ends = lists.groupBy("key").agg((F.min("pos") if left else F.max("pos")).alias("_end"))
    i = F.row_number().over(_w().orderBy("seq"))
    new = more.withColumn("_i", i).join(ends, "key", "left")
    end = F.coalesce("_end", F.lit(0))
    return lists.select("key", "pos", "value").unionByName(new.select("key", (end - F.col("_i") if left else end + F.col("_i")).alias("pos"), "value"))


def push_if_there(lists: DataFrame, more: DataFrame, left: bool = False) -> DataFrame:
    return push(lists, more.join(lists.select("key"), "key", "left_semi"), left)


def popped(lists: DataFrame, n: int, right: bool = False) -> DataFrame:
    """What a pop of n from the left (right) returns."""
    where = F.col("index") >= F.col("n") - n if right else F.col("index") < n
    return indexed(lists).where(where).select("key", "index", "value")


def after_pop(lists: DataFrame, n: int, right: bool = False) -> DataFrame:
    where = F.col("index") < F.col("n") - n if right else F.col("index") >= n
    return indexed(lists).where(where).select("key", "pos", "value")


def remove(lists: DataFrame, value: Column, count: int) -> DataFrame:
    """Without the first (count > 0), last (count < 0) or all (0) elements equal to value."""
    hit = F.col("value") == value
    if count == 0:
        return lists.where(~F.coalesce(hit, F.lit(False)))
    order = F.col("pos") if count > 0 else F.col("pos").desc()
    i = F.sum(F.coalesce(hit, F.lit(False)).cast("int")).over(_w().orderBy(order))
    return lists.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_i", i).where(~F.col("_hit") | (F.col("_i") > abs(count))).drop("_hit", "_i")


def insert(lists: DataFrame, pivot: Column, value: str, after: bool = False) -> DataFrame:
    """value before (after) the first element equal to pivot, in lists that hold it; positions are doubled to make room."""
    at = F.min(F.when(F.col("value") == pivot, F.col("pos"))).over(_w())
    marked = lists.withColumn("_at", at)
    old = marked.select("key", (F.col("pos") * 2).alias("pos"), "value")
    new = marked.where(F.col("pos") == F.col("_at")).select("key", (F.col("pos") * 2 + (1 if after else -1)).alias("pos"), F.lit(value).alias("value"))
    return old.unionByName(new)


def positions(lists: DataFrame, where: Column, rank: int = 1, count: int = 1, maxlen: int = 0) -> DataFrame:
    """Indexes of elements for which `where` holds: from the rank-th match on (negative: from the end), count of them
    (0: all), looking at maxlen elements (0: all)."""
    back = rank < 0
    look = indexed(lists)
    if maxlen:
        look = look.where(F.col("index") >= F.col("n") - maxlen if back else F.col("index") < maxlen)
    found = look.where(where).withColumn("_i", F.row_number().over(_w().orderBy(F.col("index").desc() if back else F.col("index"))))
    last = abs(rank) + count - 1 if count else None
    found = found.where(F.col("_i") >= abs(rank))
    return (found.where(F.col("_i") <= last) if last else found).select("key", "index", "value")


def move(lists: DataFrame, source, target, from_right: bool = True, to_left: bool = True) -> DataFrame:
    """One element from an end of source to an end of target."""
    one = popped(lists.where(F.col("key") == source), 1, from_right).select(F.lit(target).alias("key"), F.lit(0).alias("seq"), "value")
    rest = after_pop(lists.where(F.col("key") == source), 1, from_right).unionByName(lists.where(F.col("key") != source).select("key", "pos", "value"))
    return push(rest, one, to_left)


def pop_first_there(lists: DataFrame, keys: list, n: int, right: bool = False) -> DataFrame:
    """Pops from the first of the keys that has elements."""
    order = F.lit(None).cast("int")
    for i, k in enumerate(keys):
        order = F.when(F.col("key") == k, i).otherwise(order)
    some = lists.where(F.col("key").isin(keys)).withColumn("_o", order)
    first = F.broadcast(some.agg(F.min("_o").alias("_first")))  # one row
    return popped(some.join(first, F.col("_o") == F.col("_first")).select("key", "pos", "value"), n, right)
