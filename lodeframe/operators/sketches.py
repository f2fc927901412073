"""Sketches: distinct counts, quantiles, frequencies, heavy hitters and membership, each with an exact form beside it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of the sketch by which bounds of exact quantiles are set: ranks are off by one in so many.
ACCURACY = 10_000


def hash32(item: Column, seed: int) -> Column:
    """A portable 32-bit hash: the first eight hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), item.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


# Distinct counts: mergeable sketches of 2^14 registers.
def hll(rows: DataFrame, key: str, item: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("key")).agg(F.hll_sketch_agg(item, 14).alias("sketch"))


def hll_merge(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_union_agg("sketch").alias("sketch"))


def hll_count(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("n", F.hll_sketch_estimate("sketch")).drop("sketch")


# Count-min: rows (d, i, n) of cells, so that merging is adding.
def cms_size(error: float, failure: float) -> tuple[int, int]:
    return math.ceil(math.e / error), math.ceil(math.log(1 / failure))


def _cells(item: Column, width: int, depth: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(d).alias("d"), (hash32(item, d) % width).alias("i")) for d in range(depth)]))


def cms(rows: DataFrame, item: str, width: int, depth: int, weight: Column | None = None) -> DataFrame:
    """Counts are first added up per item, so each item is hashed once."""
    n = rows.groupBy(F.col(item).alias("_item")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    return n.select(_cells(F.col("_item"), width, depth).alias("x"), "n").groupBy("x.d", "x.i").agg(F.sum("n").alias("n"))


def cms_query(sketch: DataFrame, items: DataFrame, item: str, width: int, depth: int) -> DataFrame:
    """items with the least of their cells, never below the true count."""
    asked = items.select(F.col(item), _cells(F.col(item), width, depth).alias("x")).select(item, "x.d", "x.i")
    return asked.join(sketch, ["d", "i"], "left").groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def cms_merge(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Cell-wise weighted sum of sketches of equal size."""
    out = None
    for s, w in parts:
        one = s.select("d", "i", (F.col("n") * w).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("d", "i").agg(F.sum("n").alias("n"))


# Bloom filters: one row with an array of 64-bit words, whose number the capacity and error fix.
def bloom_size(capacity: int, error: float) -> tuple[int, int]:
    """(bits, hashes)."""
    bits = max(64, math.ceil(-capacity * math.log(error) / math.log(2) ** 2))
    return (bits + 63) // 64 * 64, max(1, math.ceil(-math.log2(error)))


def _places(item: Column, bits: int, hashes: int) -> list[Column]:
    return [(hash32(item, 0) + i * hash32(item, 1)) % bits for i in range(hashes)]


def bloom(rows: DataFrame, item: str, capacity: int, error: float) -> DataFrame:
    bits, hashes = bloom_size(capacity, error)
    at = rows.select(F.col(item).alias("_x")).distinct().select(F.explode(F.array(*_places(F.col("_x"), bits, hashes))).alias("b")).distinct()
    words = at.groupBy(F.floor(F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 AS int))")).alias("v"))
    m = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))  # at most bits / 64 entries
    return m.select(F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("words"))


def bloom_exists(sketch: DataFrame, probes: DataFrame, item: str, capacity: int, error: float) -> DataFrame:
    """probes with whether each may be a member. The filter is one row of a size that capacity and error fix."""
    bits, hashes = bloom_size(capacity, error)
    there = F.lit(True)
    for p in _places(F.col(item), bits, hashes):
        word = F.element_at("words", (F.floor(p / 64) + 1).cast("int"))
        there = there & (F.getbit(word, (p % 64).cast("int")) == 1)
    return probes.join(F.broadcast(sketch)).withColumn("maybe", there).drop("words")


def bloom_info(sketch: DataFrame, capacity: int, error: float) -> DataFrame:
    """Size of a filter, its set bits, and how many items these speak for."""
    bits, hashes = bloom_size(capacity, error)
    ones = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))
    out = sketch.select(ones.alias("set_bits"))
    card = F.round(-bits / hashes * F.log(1 - F.col("set_bits") / float(bits))).cast("long")
    return out.select(*[F.lit(x).cast("long").alias(n) for n, x in (("capacity", capacity), ("bits", bits), ("hashes", hashes))], "set_bits", card.alias("card"))


def bloom_dump(sketch: DataFrame, words: int = 1024) -> DataFrame:
    """(i, chunk): the filter in pieces of so many words, as a table that can be kept."""
    n = F.ceil(F.size("words") / words).cast("int")
    return sketch.select(F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), "words").select("i", F.expr(f"slice(words, i * {words} + 1, {words})").alias("chunk"))


def bloom_load(chunks: DataFrame) -> DataFrame:
    """The filter of its pieces, in whatever order they come; of a piece that comes twice one counts."""
    once = chunks.groupBy("i").agg(F.first("chunk").alias("chunk"))
    return once.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", "chunk"))), lambda x: x["chunk"])).alias("words"))  # a filter's fixed size


# Multisets, of which a cuckoo filter answers the same questions approximately.
def bag(rows: DataFrame, item: str) -> DataFrame:
    return rows.groupBy(item).agg(F.count("*").alias("n"))


def bag_delete(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """One occurrence goes for each row of gone."""
    return rows.exceptAll(gone)


def bag_add_new(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows with those of more that they lack, each once."""
    return rows.unionByName(more.distinct().join(rows, more.columns, "left_anti"))


def bag_exists(rows: DataFrame, probes: DataFrame, item: str) -> DataFrame:
    there = rows.select(item).distinct().withColumn("_there", F.lit(True))
    return probes.join(there, item, "left").select(item, F.coalesce("_there", F.lit(False)).alias("there"))


# Heavy hitters.
def top(rows: DataFrame, item: str, k: int, weight: Column | None = None) -> DataFrame:
    n = F.count("*") if weight is None else F.sum(weight)
    return rows.groupBy(item).agg(n.alias("n")).orderBy(F.col("n").desc(), item).limit(k)


def top_approx(rows: DataFrame, item: str, k: int) -> DataFrame:
    return rows.agg(F.expr(f"approx_top_k({item}, {int(k)})").alias("_t")).select(F.explode("_t").alias("_x")).select("_x.*")


# Quantiles.
def quantiles(rows: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """Exact, with interpolation; null without values. A sketch gives bounds of each quantile, and how many values lie
    below and within them is counted. Only the values within, a share of about 6 / `ACCURACY`, are put in order by one
    task; if a place asked for is not within, the bounds are set farther apart."""
    if not isinstance(rows.select(value).schema[0].dataType, T.NumericType):
        return rows.agg(F.percentile(value, F.array(*[F.lit(q) for q in qs])).alias("q"))
    if not all(0 <= q <= 1 for q in qs):
        raise ValueError(f"not within 0 and 1: {qs}")
    v = rows.select(F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    out, apart, todo = {}, 2 / ACCURACY, list(range(len(qs)))
    while todo:
        at = [min(1.0, max(0.0, qs[i] + d)) for i in todo for d in (-apart, apart)]
        bounds = v.agg(F.percentile_approx("_v", F.array(*map(F.lit, at)), ACCURACY).alias("b")).first().b  # one row
        if bounds is None:
            return rows.sparkSession.range(1).select(F.lit(None).cast("array<double>").alias("q"))
        if apart >= 1:
            bounds = [-math.inf, math.nan] * len(todo)
        low, high = bounds[::2], bounds[1::2]
        c = v.agg(F.count("*").alias("n"), *[x for i in range(len(todo)) for x in (F.count_if(F.col("_v") < low[i]).alias(f"b{i}"), F.count_if(F.col("_v") <= high[i]).alias(f"u{i}"))]).first()  # one row
        for j, i in enumerate(todo):
            place = (c.n - 1) * qs[i]
            if c[f"b{j}"] <= math.floor(place) and math.ceil(place) < c[f"u{j}"]:
                out[i] = (low[j], high[j], c[f"b{j}"], place)
        todo, apart = [i for i in todo if i not in out], apart * 8
    asked = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(x).alias(n) for n, x in zip(("low", "high", "below", "place"), out[i], strict=True)]) for i in range(len(qs))])
    within = v.select("_v", F.explode(F.filter(asked, lambda x: F.col("_v").between(x["low"], x["high"]))).alias("_a")).groupBy("_a", "_v").agg(F.count("*").alias("_n"))
    upto = F.col("_a.below") + F.sum("_n").over(Window.partitionBy("_a.i").orderBy("_v"))
    here = lambda x: F.max(F.when((F.col("_upto") > x) & (F.col("_upto") - F.col("_n") <= x), F.col("_v")))
    p = F.col("_a.place")
    ends = within.withColumn("_upto", upto).groupBy("_a").agg(here(F.floor(p)).alias("_x"), here(F.ceil(p)).alias("_y"))
    q = F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise((F.ceil(p) - p) * F.col("_x") + (p - F.floor(p)) * F.col("_y"))
    return ends.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("_a.i").alias("i"), q.alias("q")))), lambda x: x["q"]).alias("q"))


def quantile_sketch(rows: DataFrame, key: str, value: str, alpha: float) -> DataFrame:
    """(key, bucket, n): counts of positive values in buckets whose bounds grow by (1 + alpha) / (1 - alpha), so that a
    quantile is off by a share of alpha at most. Their number follows the range of the values, not how many there are; they
    can be kept as a table, and merging is adding."""
    step = math.log(1 + alpha) - math.log(1 - alpha)
    at = F.ceil(F.round(F.log(F.col(value).cast("double")) / step, 9)).cast("long")
    return rows.where(F.col(value) > 0).groupBy(F.col(key).alias("key"), at.alias("bucket")).agg(F.count("*").alias("n"))


def sketch_merge(sketches: list[DataFrame]) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("key", "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, qs: list[float], alpha: float) -> DataFrame:
    """(key, q, value) of sketches, by windows over their few buckets."""
    step, w = math.log(1 + alpha) - math.log(1 - alpha), Window.partitionBy("key")
    c = sketch.withColumn("_upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("_total", F.sum("n").over(w))
    c = c.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).where(F.col("_upto") >= F.ceil(F.col("q") * F.col("_total")))
    return c.groupBy("key", "q").agg(F.min("bucket").alias("_b")).select("key", "q", (2 * F.exp(F.col("_b") * step) / (math.exp(step) + 1)).alias("value"))


def quantiles_approx(rows: DataFrame, value: str, qs: list[float]) -> DataFrame:
    return rows.agg(F.kll_sketch_agg_double(value).alias("_s")).select(F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(q) for q in qs])).alias("q"))


def cdf(rows: DataFrame, value: str, xs: list[float]) -> DataFrame:
    """(x, fraction): share of the values at or below each x."""
    found = rows.agg(*[F.avg((F.col(value) <= x).cast("double")).alias(f"c{i}") for i, x in enumerate(xs)])
    return found.select(F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.col(f"c{i}").alias("fraction")) for i, x in enumerate(xs)])).alias("s")).select("s.*")


def rank(rows: DataFrame, value: str, x: float, reverse: bool = False) -> DataFrame:
    """How many values are at or below x (above, if reversed); -1 below the least, -2 without values."""
    below = F.count_if(F.col(value) <= x)
    r = F.count(value) - below if reverse else below
    empty = F.count(value) == 0
    return rows.agg(F.when(empty, -2).when((F.min(value) > x) if not reverse else (F.max(value) < x), -1).otherwise(r).cast("long").alias("rank"))


def by_rank(rows: DataFrame, value: str, r: int, reverse: bool = False) -> DataFrame:
    """The value of a rank from 0; none beyond the end."""
    return rows.select(value).orderBy(F.col(value).desc() if reverse else F.col(value)).offset(r).limit(1)


def trimmed_mean(rows: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    """Per key the mean of the values between two quantiles, those at the edges counting for the part within."""
    w = Window.partitionBy(key)
    i = F.row_number().over(w.orderBy(value))
    n = F.count(value).over(w)
    within = F.greatest(F.lit(0.0), F.least(F.col("_i"), F.col("_n") * high) - F.greatest(F.col("_i") - 1, F.col("_n") * low))
    out = rows.where(F.col(value).isNotNull()).withColumn("_i", i.cast("double")).withColumn("_n", n.cast("double")).withColumn("_w", within)
    return out.groupBy(key).agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("mean"))
