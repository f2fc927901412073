"""Geo points as expressions: 52-bit interleaved cells, their text form, distances, and searches by radius or box.

Positions are the centres of cells, as a stored point is its cell. Searches first restrict to a band of latitudes,
which Parquet statistics can prune, and join on coarse cells where many centres are asked for at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The latitude limit of the projection, the earth's radius in metres, units in metres, the alphabet.
LAT_MAX, RADIUS_M = 85.05112878, 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
_STEPS = 26
#: Rows of one side of a block of the radius join, and the most tasks that its blocks are dealt to.
BLOCK, TASKS = 4_096, 10_000
#: Fixed values: (shift, mask) that spread 32 bits to the even places of 64.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _steps(x: Column, steps: list[tuple[int, int]], shift: str) -> Column:
    """x = (x | x shifted) & mask for each step. A fold, as x written out twice a step would double it each time."""
    table = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).cast("long").alias("m")) for s, m in steps])
    return F.aggregate(table, x.cast("long"), lambda a, p: a.bitwiseOR(F.call_function(shift, a, p["s"])).bitwiseAND(p["m"]))


def _spread(x: Column) -> Column:
    return _steps(x, list(_SPREAD), "shiftleft")


def _squeeze(x: Column) -> Column:
    masks = [m for _, m in _SPREAD[::-1][1:]] + [0x00000000FFFFFFFF]
    return _steps(x.bitwiseAND(F.lit(_SPREAD[-1][1])), [(s, m) for (s, _), m in zip(_SPREAD[::-1], masks, strict=True)], "shiftright")


def _cell(x: Column, low: float, width: float) -> Column:
    return F.least(F.floor((x - F.lit(low)) / F.lit(width) * F.lit(float(1 << _STEPS))), F.lit((1 << _STEPS) - 1)).cast("long")


def encode(lon: Column, lat: Column) -> Column:
    """The cell of a point, latitude in the even bits; null outside the limits."""
    ok = lon.between(-180, 180) & lat.between(-LAT_MAX, LAT_MAX)
    return F.when(ok, _spread(_cell(lat, -LAT_MAX, 2 * LAT_MAX)).bitwiseOR(F.shiftleft(_spread(_cell(lon, -180.0, 360.0)), 1)))


def decode(cell: Column) -> tuple[Column, Column]:
    """(lon, lat) of a cell's centre."""
    n = float(1 << _STEPS)
    lon = F.lit(-180.0) + (_squeeze(F.shiftright(cell, 1)) + F.lit(0.5)) / n * 360.0
    lat = F.lit(-LAT_MAX) + (_squeeze(cell) + F.lit(0.5)) / n * (2 * LAT_MAX)
    return lon, lat


def hash_string(cell: Column) -> Column:
    """Eleven letters of the usual form, whose latitudes run to the poles; the last one is always the first letter."""
    lon, lat = decode(cell)
    bits = F.shiftleft(_spread(_cell(lon, -180.0, 360.0)), 1).bitwiseOR(_spread(_cell(lat, -90.0, 180.0)))
    letter = lambda b, i: F.substr(F.lit(ALPHABET), (F.shiftright(b, 52 - 5 * (i + 1)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    spelt = F.transform(F.array(bits), lambda b: F.concat(*[letter(b, i) for i in range(10)], F.lit(ALPHABET[0])))
    return F.element_at(spelt, 1)


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """Great-circle distance by the haversine formula."""
    a, b, c, e = (F.radians(x) for x in (lat1, lat2, lon1, lon2))
    u, v = F.sin((b - a) / 2), F.sin((e - c) / 2)
    return F.lit(2.0) * RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), u * u + F.cos(a) * F.cos(b) * v * v))) / F.lit(UNITS[unit])


def _band(lat: float, metres: float) -> Column:
    """Latitudes within reach of a centre."""
    d = math.degrees(metres / RADIUS_M) * 1.000001 + 1e-5
    return F.col("lat").between(lat - d, lat + d)


def within_radius(points: DataFrame, lon: float, lat: float, radius: float, unit: str = "m") -> DataFrame:
    """points (lon, lat, more) within a radius; adds dist in the unit."""
    near = points.where(_band(lat, radius * UNITS[unit]))
    d = distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"), unit)
    return near.withColumn("dist", d).where(F.col("dist") <= radius)


def within_box(points: DataFrame, lon: float, lat: float, width: float, height: float, unit: str = "m") -> DataFrame:
    """points within a box: latitude within half the height, longitude, at the point's latitude, within half the width."""
    near = points.where(_band(lat, height / 2 * UNITS[unit]))
    north = distance(F.col("lon"), F.lit(lat), F.col("lon"), F.col("lat"), unit)
    east = distance(F.lit(lon), F.col("lat"), F.col("lon"), F.col("lat"), unit)
    d = distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"), unit)
    return near.where((north <= height / 2) & (east <= width / 2)).withColumn("dist", d)


def nearest(points: DataFrame, lon: float, lat: float, k: int, unit: str = "m") -> DataFrame:
    """The k nearest points; ties go by member."""
    d = distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"), unit)
    return points.withColumn("dist", d).orderBy("dist", "member").limit(k)


def radius_join(points: DataFrame, centres: DataFrame, radius: float, unit: str = "km") -> DataFrame:
    """Pairs of centres (id, clon, clat) and points within a radius, for many centres.

    Both sides get a square of `step` degrees of latitude and a count of columns that fits that row of squares; a
    centre takes its row's and the next rows' columns in reach, so the join is on equal squares. Both sides of a square
    are cut into parts of about `BLOCK` rows and each pair of parts is a block. Blocks are dealt to tasks by how many
    pairs there are, as bytes say little of the work: a job whose rows fit into one task may hold billions of pairs.
    """
    step = max(0.05, math.degrees(radius * UNITS[unit] / RADIUS_M) * 1.000001)
    row = lambda lat: F.floor((lat + 90.0) / step).cast("int")
    # Columns of a row: as many as leave each at least as wide as the reach at the row's widest-reaching latitude.
    edge = lambda r: F.greatest(F.abs(r * step - 90.0), F.abs((r + 1) * step - 90.0))
    columns = lambda r: F.when(edge(r) >= 89.0 - step, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0 / step) * F.cos(F.radians(edge(r) + step))).cast("int")))
    own = points.withColumn("_r", row(F.col("lat"))).withColumn("_n", columns(F.col("_r")))
    own = own.withColumn("_c", F.least(F.floor((F.col("lon") + 180.0) / 360.0 * F.col("_n")), F.col("_n") - 1).cast("int")).drop("_n")
    asked = centres.withColumn("_r", F.explode(F.array(*[row(F.col("clat")) + i for i in (-1, 0, 1)]))).withColumn("_n", columns(F.col("_r")))
    at = F.least(F.floor((F.col("clon") + 180.0) / 360.0 * F.col("_n")), F.col("_n") - 1)
    asked = asked.withColumn("_c", F.explode(F.array_distinct(F.array(*[F.pmod(at + i, F.col("_n")).cast("int") for i in (-1, 0, 1)])))).drop("_n")
    one = lambda rows, a, b: rows.select("_r", "_c", F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    squares = one(own, 1, 0).unionByName(one(asked, 0, 1)).groupBy("_r", "_c").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    pairs = squares.agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0.0  # one row
    tasks = max(own.sparkSession.sparkContext.defaultParallelism, min(TASKS, math.ceil(pairs / BLOCK**2)))
    # Of squares with more than a block, of which there is one for BLOCK rows at most, into how many parts each side goes.
    cut = F.broadcast(squares.where(F.greatest("_a", "_b") > BLOCK).select("_r", "_c", *[F.greatest(F.lit(1), F.ceil(F.col(x) / BLOCK)).cast("int").alias(x) for x in ("_a", "_b")]))
    near = ["_r", "_c", "_i", "_j"]
    parts = lambda n: F.coalesce(F.col(n), F.lit(1))

    def dealt(rows: DataFrame, names: list[str], i: str, n: str, j: str, m: str) -> DataFrame:
        """Rows with a part of their own side, by a hash of what they hold, for each part of the other one."""
        rows = rows.join(cut, ["_r", "_c"], "left").withColumn(i, F.pmod(F.xxhash64(*names), parts(n)).cast("int"))
        return rows.withColumn(j, F.explode(F.sequence(F.lit(0), parts(m) - 1))).drop("_a", "_b")

    plain = lambda rows: [f.name for f in rows.schema if isinstance(f.dataType, T.AtomicType)]
    # Unit vectors, whose product is the cosine of the angle: it leaves out most pairs before a distance is worked out.
    own = _unit(dealt(own, plain(points), "_i", "_a", "_j", "_b"), "lon", "lat", "_p")
    asked = _unit(dealt(asked, plain(centres), "_j", "_b", "_i", "_a"), "clon", "clat", "_q")
    own, asked = (x.repartition(tasks, *near) for x in (own, asked))
    found = own.join(asked.hint("shuffle_hash"), near)
    least = math.cos(min(math.pi, radius * UNITS[unit] / RADIUS_M)) - 1e-9
    d = distance(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat"), unit)
    found = found.where(F.col("_p0") * F.col("_q0") + F.col("_p1") * F.col("_q1") + F.col("_p2") * F.col("_q2") >= least)
    return found.withColumn("dist", d).where(F.col("dist") <= radius).drop(*near, *[f"_{x}{i}" for x in "pq" for i in range(3)])


def _unit(rows: DataFrame, lon: str, lat: str, name: str) -> DataFrame:
    """rows with the unit vector of a point as three columns."""
    a, o = F.radians(lat), F.radians(lon)
    return rows.withColumns({f"{name}0": F.cos(a) * F.cos(o), f"{name}1": F.cos(a) * F.sin(o), f"{name}2": F.sin(a)})


def store(found: DataFrame, key: str) -> DataFrame:
    """A search's result (member, dist) as a sorted set scored by distance."""
    return found.select(F.lit(key).alias("key"), "member", F.round("dist", 4).alias("score"))
