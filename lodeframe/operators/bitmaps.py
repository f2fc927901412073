"""Bitmaps as rows (key, bit), and as binary values whose bits count from the most significant of each byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_bits(bits: DataFrame, more: DataFrame) -> DataFrame:
    return bits.select("key", "bit").unionByName(more.select("key", "bit")).distinct()


def get_bits(bits: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (key, bit): whether each is set."""
    there = bits.select("key", "bit").distinct().withColumn("_in", F.lit(1))
    return probes.join(there, ["key", "bit"], "left").withColumn("value", F.coalesce("_in", F.lit(0))).drop("_in")


def count(bits: DataFrame, start: int | None = None, stop: int | None = None, unit: str = "byte") -> DataFrame:
    """Set bits of each key between two bytes (or bits), both included."""
    at = F.col("bit") if unit == "bit" else F.floor(F.col("bit") / 8)
    if start is not None:
        bits = bits.where(at.between(start, stop))
    return bits.groupBy("key").agg(F.count_distinct("bit").alias("n"))


def first_set(bits: DataFrame) -> DataFrame:
    return bits.groupBy("key").agg(F.min("bit").alias("bit"))


def first_clear(bits: DataFrame) -> DataFrame:
    """The first bit that is not set: where the sorted bits first leave the count 0, 1, 2, ..."""
    w = Window.partitionBy("key").orderBy("bit")
    run = bits.select("key", "bit").distinct().withColumn("_i", F.row_number().over(w) - 1)
    return run.groupBy("key").agg(F.count_if(F.col("bit") == F.col("_i")).alias("bit"))


def combine(bits: DataFrame, keys: list, op: str, size: int | None = None) -> DataFrame:
    """(bit) of a combination of keys: and, or, xor, one (in exactly one), diff (in the first, no other), diff1 (in
    another, not the first), andor (in the first and another), not (of one key, up to `size` bits)."""
    mine = bits.where(F.col("key").isin(keys)).select("key", "bit").distinct()
    if op == "not":
        every = bits.sparkSession.range(size).select(F.col("id").alias("bit"))
        return every.join(mine.select("bit"), "bit", "left_anti")
    n = mine.groupBy("bit").agg(F.count("*").alias("n"), F.count_if(F.col("key") == keys[0]).alias("first"))
    first, n_, others = F.col("first") == 1, F.col("n"), F.col("n") - F.col("first")
    test = {
        "and": n_ == len(set(keys)), "or": n_ > 0, "xor": n_ % 2 == 1, "one": n_ == 1,
        "diff": first & (others == 0), "diff1": ~first & (others > 0), "andor": first & (others > 0),
    }[op]
    return n.where(test).select("bit")


def field(value: Column, kind: str, offset: int) -> Column:
    """An integer of a binary value: kind is u1..u63 or i1..i64, offset in bits; bytes beyond the end are zero."""
    bits, first, last = int(kind[1:]), offset // 8, (offset + int(kind[1:]) - 1) // 8
    padded = F.rpad(value, last + 1, F.lit(b"\0"))
    out = F.lit(0).cast("long")
    for i in range(first, last + 1):
        byte = F.conv(F.hex(F.substring(padded, i + 1, 1)), 16, 10).cast("long")
        shift = (offset + bits) - 8 * (i + 1)  # places the byte stands above the field's end
        part = F.shiftleft(byte, shift) if shift >= 0 else F.shiftright(byte, -shift)
        out = out.bitwiseOR(part)
    if bits < 64:
        out = out.bitwiseAND(F.lit((1 << bits) - 1))
        if kind[0] == "i":
            out = F.when(F.shiftright(out, bits - 1) == 1, out - F.lit(1 << bits) if bits < 63 else out.bitwiseOR(F.lit(-(1 << bits)))).otherwise(out)
    return out


def overflow(value: Column, kind: str, how: str = "wrap") -> Column:
    """A sum (as decimal or long) brought into a field's range: wrap, sat, or fail (null)."""
    bits = int(kind[1:])
    low, high = (0, (1 << bits) - 1) if kind[0] == "u" else (-(1 << bits - 1), (1 << bits - 1) - 1)
    v = value.cast("decimal(38,0)")
    dec = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    inside = (v >= dec(low)) & (v <= dec(high))
    if how == "sat":
        return F.least(F.greatest(v, dec(low)), dec(high)).cast("long")
    if how == "fail":
        return F.when(inside, v).cast("long")
    return (F.pmod(v - dec(low), dec(1 << bits)) + dec(low)).cast("long")


def pack(bits: DataFrame, size: int) -> DataFrame:
    """(key, value): the bitmap of each key as binary of `size` bytes, built from its distinct bytes."""
    byte = bits.select("key", "bit").distinct().groupBy("key", F.floor(F.col("bit") / 8).cast("int").alias("b")).agg(F.sum(F.expr("shiftright(128, cast(bit % 8 AS int))")).alias("v"))
    return byte.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("_m")).select(
        "key", F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.col("_m")[i], F.lit(0))), 2, "0")), "")).alias("value"))
