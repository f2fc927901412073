"""Hashes as rows (key, field, value), and their wide and map forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.glob import matches


def from_columns(table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row per field of each row of a table, as strings; nulls are fields that are not there."""
    wide = table.select(F.col(key).alias("key"), *[F.col(c).cast("string").alias(c) for c in fields])
    return wide.unpivot("key", fields, "field", "value").where("value IS NOT NULL")


def get(hashes: DataFrame, field: str) -> DataFrame:
    return hashes.where(F.col("field") == field).select("key", "value")


def get_all(hashes: DataFrame) -> DataFrame:
    """(key, fields): the hash as a map."""
    return hashes.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


def multi_get(hashes: DataFrame, fields: list[str]) -> DataFrame:
    """One column per field asked for, null where it is missing; one aggregation."""
    return hashes.groupBy("key").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def keys(hashes: DataFrame) -> DataFrame:
    return hashes.select("key", "field").distinct()


def values(hashes: DataFrame) -> DataFrame:
    return hashes.select("key", "value")


def length(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.count("*").alias("length"))


def exists(hashes: DataFrame, field: str) -> DataFrame:
    return hashes.groupBy("key").agg(F.bool_or(F.col("field") == field).alias("there"))


def set_(hashes: DataFrame, more: DataFrame) -> DataFrame:
    """more (key, field, value, seq) put in, the last one winning."""
    old = hashes.select("key", "field", "value", F.lit(-1).cast("long").alias("seq"))
    new = more.select("key", "field", "value", F.col("seq").cast("long"))
    return old.unionByName(new).groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))


def set_if_absent(hashes: DataFrame, more: DataFrame) -> DataFrame:
    return hashes.unionByName(more.join(hashes.select("key", "field"), ["key", "field"], "left_anti"))


def delete(hashes: DataFrame, where: Column) -> DataFrame:
    return hashes.where(~where)


def increment(hashes: DataFrame, deltas: DataFrame, kind: str = "long") -> DataFrame:
    """deltas (key, field, value) added to fields read as numbers; missing ones start from 0."""
    both = hashes.select("key", "field", F.col("value").cast(kind)).unionByName(deltas.select("key", "field", F.col("value").cast(kind)))
    return both.groupBy("key", "field").agg(F.sum("value").alias("value"))


def string_length(hashes: DataFrame, field: str) -> DataFrame:
    return hashes.where(F.col("field") == field).select("key", F.octet_length("value").cast("long").alias("length"))


def random_fields(hashes: DataFrame, n: int, seed: str, repeats: bool = False) -> DataFrame:
    """n fields of each hash in a reproducible random order; with repeats, n draws of which each may be any field."""
    draw = lambda *c: F.md5(F.concat_ws(":", F.lit(seed), *c).cast("binary"))
    if not repeats:
        w = Window.partitionBy("key").orderBy(draw("field"), "field")
        return hashes.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")
    w = Window.partitionBy("key")
    place = hashes.withColumn("_i", F.row_number().over(w.orderBy("field")) - 1)
    sizes = hashes.groupBy("key").agg(F.count("*").alias("_n"))
    drawn = sizes.select("key", "_n", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    number = F.conv(F.substring(draw(F.col("key").cast("string"), F.col("draw").cast("string")), 1, 8), 16, 10).cast("long")
    return drawn.withColumn("_i", (number % F.col("_n")).cast("int")).join(place, ["key", "_i"]).select("key", "draw", "field", "value")


def scan(hashes: DataFrame, pattern: str) -> DataFrame:
    return hashes.where(matches(F.col("field"), pattern))


def get_and_delete(hashes: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what was there, what is left)."""
    hit = F.col("field").isin(fields)
    return hashes.where(hit), hashes.where(~hit)
