"""Vector sets as rows (element, embedding array<float>, attrs): exact similarity searches.

Distances are sums over zipped arrays in double precision. One query is a constant array in a map-only projection and
an ordered limit. A batch of queries goes in groups that meet blocks of vectors as matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.operators.filterexpr import compile_filter

#: Queries and vectors of a block. Of a task: numbers in its queries, vectors, numbers in double precision at once.
QUERIES, VECTORS = 512, 4_096
GROUP, PART, CELLS = 1 << 22, 262_144, 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, within 0..2; 1 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) - dot(a, b) / n)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / 2, within 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - cosine_distance(a, b) / 2))


def constant(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def similar(vectors: DataFrame, query: list[float], count: int = 10, epsilon: float | None = None, where: str | None = None) -> DataFrame:
    """(element, score): the `count` most similar elements among those that a filter lets through; ties by element."""
    if where:
        vectors = vectors.where(compile_filter(where))
    q = constant(query)
    if epsilon is not None:
        vectors = vectors.where(cosine_distance(F.col("embedding"), q) <= 2 * epsilon)
    return vectors.select("element", similarity(F.col("embedding"), q).alias("score")).orderBy(F.col("score").desc(), "element").limit(count)


def vector_of(vectors: DataFrame, element) -> list[float]:
    row = vectors.where(F.col("element") == element).select("embedding").first()
    if row is None:
        raise KeyError(element)
    return row[0]


def distances(q: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    """Rows of q by rows of x; cosine distance is 1 where a vector is zero."""
    at, on = np.indices((len(q), len(x))).reshape(2, -1)
    return _apart(q, x, at, on, kind).reshape(len(q), len(x))


def _apart(q: np.ndarray, x: np.ndarray, at: np.ndarray, on: np.ndarray, kind: str) -> np.ndarray:
    """Distances of rows `at` of q from rows `on` of x, in double precision and some of them at a time."""
    out, size = np.empty(len(at)), max(1, CELLS // max(1, q.shape[1]))
    for i in range(0, len(at), size):
        a, b = q[at[i : i + size]].astype(np.float64), x[on[i : i + size]].astype(np.float64)
        if kind == "l2":
            out[i : i + size] = np.sqrt(np.square(a - b).sum(1))
            continue
        dot = np.einsum("ij,ij->i", a, b)
        if kind == "ip":
            out[i : i + size] = -dot
            continue
        n = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
        out[i : i + size] = np.where(n == 0, 1.0, np.clip(1 - dot / np.where(n == 0, 1.0, n), 0.0, 2.0))
    return out


def _screen(v: np.ndarray, kind: str, asked: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in single precision whose products fall as the distance grows, and their norms: 1 - product is the cosine
    distance, -product that of "ip", and the squared norm of a query less twice the product is the square of l2's."""
    n = np.sqrt(np.square(v, dtype=np.float64).sum(1))
    if kind == "cosine":
        v, n = v / np.where(n == 0, 1.0, n)[:, None], np.ones(len(v))
    if kind == "l2":
        last = np.ones(len(v)) if asked else -n * n / 2
        v, n = np.column_stack([v, last]), np.sqrt(n * n + last * last)
    return v.astype(np.float32), n


class _Nearest:
    """The k nearest of some queries among vectors that come in blocks. A block's products in single precision, with their
    error, leave out what cannot be near enough; only the others' distances are worked out."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, kind: str):
        self.ids, self.q, self.k, self.kind = ids, q, k, kind
        self.s, self.norms = _screen(q, kind, True)
        self.square = np.square(q, dtype=np.float64).sum(1) if kind == "l2" else None
        self.d, self.found = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        s, norms = _screen(x, self.kind, False)
        s = np.ascontiguousarray(s.T)
        error = (2 * len(s) + 16) * 2.0**-23 * self.norms * norms.max(initial=0.0)
        for i in range(0, len(self.q), QUERIES):
            part = slice(i, min(i + QUERIES, len(self.q)))
            products, far = self.s[part] @ s, self.d[part, -1] + 1e-9
            least = {"cosine": lambda f: 1 - f, "ip": lambda f: -f, "l2": lambda f, part=part: (self.square[part] - f * f) / 2}[self.kind](far) - error[part]
            if len(ids) > self.k + 1 and np.isinf(far).any():  # one more, as a query is not its own neighbour
                best = -np.partition(-products, self.k, axis=1)[:, self.k].astype(np.float64)
                # A square root's rounding to ten digits is 2e-10 of a distance, or of its square where that is small.
                least = np.fmax(least, best - 2 * error[part] - 1e-9 * (1 + np.sqrt(np.maximum(self.square[part] - 2 * best, 0)) if self.kind == "l2" else 1))
            least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
            at, on = np.nonzero(~(products < least[:, None]))
            self._keep(at + i, on, ids, x)

    def _keep(self, at: np.ndarray, on: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        for j in range(0, len(at), CELLS):
            a, o = at[j : j + CELLS], on[j : j + CELLS]
            d, e = np.round(_apart(self.q, x, a, o, self.kind), 10), ids[o]
            last, who = self.d[a, -1], self.found[a, -1]
            near = (e != self.ids[a]) & (d < np.inf) & ((d < last) | ((d == last) & (e < who)))
            a, d, e = a[near], d[near], e[near]
            some = np.unique(a)
            a = np.concatenate([a, np.repeat(some, self.k)])
            d, e = np.concatenate([d, self.d[some].ravel()]), np.concatenate([e, self.found[some].ravel()])
            order = np.lexsort((e, d, a))
            a, d, e = a[order], d[order], e[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            best = place < self.k
            self.d[a[best], place[best]], self.found[a[best], place[best]] = d[best], e[best]

    def rows(self) -> pa.RecordBatch:
        there = self.d < np.inf
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, there.sum(1))), pa.array(self.found[there]), pa.array(self.d[there])], ["query", "element", "distance"])


def batch(vectors: DataFrame, queries: DataFrame, k: int, kind: str = "cosine") -> DataFrame:
    """queries (query, q): (query, element, distance, rank) of the k nearest of each, exactly. Distances that agree to ten
    digits are ties and go by element. Every group of queries, of about `GROUP` numbers, meets every part of about `PART`
    vectors in one task, which reads the part once and holds its queries and a block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asked, near = None, [], None
        for b in batches:
            t, seen = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            cuts = [0, *(np.flatnonzero((np.diff(t) != 0) | (np.diff(seen) != 0)) + 1).tolist(), len(t)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if stop == start:
                    continue
                if t[start] != task:
                    if near is not None:
                        yield near.rows()
                    task, asked, near = t[start], [], None
                part = b.slice(start, stop - start)
                ids = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                x = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                if not seen[start]:
                    asked.append((ids, x.copy()))
                    continue
                if asked:
                    near, asked = _Nearest(*map(np.concatenate, zip(*asked, strict=True)), k, kind), []
                for i in range(0, len(ids) if near is not None else 0, VECTORS):
                    near.see(ids[i : i + VECTORS], x[i : i + VECTORS])
        if near is not None:
            yield near.rows()

    rows = lambda df, i, v, seen: df.where(F.col(v).isNotNull()).select(F.lit(seen).alias("seen"), F.col(i).cast("long").alias("id"), F.col(v).alias("x"))
    x, q = rows(vectors, "element", "embedding", True), rows(queries, "query", "q", False)
    n, cores = x.count(), x.sparkSession.sparkContext.defaultParallelism
    asked = q.agg(F.sum(F.size("x").cast("long"))).first()[0] or 0  # one row
    groups = max(1, math.ceil(asked / GROUP))
    parts = max(1, math.ceil(n / PART), min(math.ceil(n / VECTORS), math.ceil(2 * cores / groups)))
    deal = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = q.withColumn("_g", deal(groups)).withColumn("_v", each(parts))
    x = x.withColumn("_v", deal(parts)).withColumn("_g", each(groups))
    met = q.unionByName(x).select((F.col("_g") * parts + F.col("_v")).alias("task"), "seen", "id", "x")
    near = met.repartitionById(groups * parts, F.col("task")).sortWithinPartitions("task", "seen").mapInArrow(run, "query long, element long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "element")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def reduce_dimension(embedding: Column, size: int, dim: int, seed: int = 1) -> Column:
    """A Gaussian random projection to `size` components."""
    import random

    rng = random.Random(seed)
    rows = [[rng.gauss(0, dim**-0.5) for _ in range(dim)] for _ in range(size)]
    return F.transform(F.array(*[constant(r) for r in rows]), lambda r: dot(embedding, r))


def quantise(embedding: Column) -> Column:
    """8-bit form: components scaled so that the largest is 127."""
    top = F.array_max(F.transform(embedding, lambda x: F.abs(x)))
    return F.transform(embedding, lambda x: F.when(top == 0, 0).otherwise(F.round(x / top * 127)).cast("tinyint"))


def binary(embedding: Column) -> Column:
    """One bit per component: whether it is positive."""
    return F.transform(embedding, lambda x: (x > 0).cast("tinyint"))


def hamming(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)).cast("long")


def upsert(vectors: DataFrame, more: DataFrame) -> DataFrame:
    """vectors with the rows of more, which replace those of the same element; vectors of another length are refused."""
    dim = vectors.agg(F.max(F.size("embedding")).alias("_dim"))  # one row
    fits = more.join(F.broadcast(dim), F.col("_dim").isNull() | (F.size("embedding") == F.col("_dim"))).select(*more.columns)
    return vectors.join(fits.select("element"), "element", "left_anti").unionByName(fits)


def is_member(vectors: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (element) with whether the set has it."""
    there = vectors.select("element", F.lit(True).alias("_there"))
    return probes.join(there, "element", "left").select("element", F.coalesce("_there", F.lit(False)).alias("is_member"))


def info(vectors: DataFrame) -> DataFrame:
    """(size, dim, with_attrs) of a set."""
    return vectors.agg(F.count("*").alias("size"), F.max(F.size("embedding")).cast("long").alias("dim"), F.count("attrs").alias("with_attrs"))


def raw(vectors: DataFrame) -> DataFrame:
    """(element, kind, data, norm): components divided by the norm, as they are compared, and the norm to restore them."""
    n = norm(F.col("embedding"))
    unit = F.transform("embedding", lambda x: F.when(n == 0, 0.0).otherwise(x.cast("double") / n))
    return vectors.select("element", F.lit("f32").alias("kind"), unit.alias("data"), n.alias("norm"))
