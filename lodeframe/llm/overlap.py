"""The exact part of operator 4: Jaccard similarity of word shingles, as a check of links and as a way for the rest.

A radius of fingerprints misses some pairs of similar texts. Those come from a prefix filter, which is exact under
any order of the shingles: two sets that overlap so much share one of the first n - ceil(n * similarity) + 1.

1. Longer prefixes share more: of the first n - ceil(n * similarity) + n / 10 in the order of the hashes, two similar
   texts share 0.08 n. Texts of whose first shingles fewer occur elsewhere have no similar one and end here.
2. The others' shingles are counted and ordered by how many texts hold them, so that passages which many texts share
   come last. Texts with one of the first shingles are a bucket. Of buckets with the same texts one is enough, and a
   bucket whose texts are linked already is left out.
3. The texts of a bucket's largest known component are dealt to blocks, each of which meets the bucket's other texts
   once. A search takes out what it finds: spanning links, never all pairs, each checked with the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import hinted, sliced, written

#: Members of a bucket's largest component that one task compares with the others.
BLOCK = 2_048
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes (unsigned) of a text's shingles; of at most `size` words one, of none that of zero."""
    import xxhash

    ws = text.lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws)) if ws else np.zeros(1, np.uint64)
    n = max(1, len(h) - size + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(min(size, len(h))):
            out = out * _STEP + h[k : k + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def first_ones(n: int, similar: tuple[int, int]) -> int:
    """How many of n ordered shingles are looked at first. Sets of n <= m share min(m, n) / 10 of them, one at least:
    they overlap by m * similarity, so all but n - m * similarity of the smaller set's are shared."""
    p, q = similar
    return n - -(-n * p // q) + max(1, n // 10)


def least_shared(n: Column, similar: tuple[int, int]) -> Column:
    """Of those, how many a text with a similar one shares: a tenth of the smallest set that is similar to n."""
    p, q = similar
    return F.greatest(F.lit(1), F.floor(n * p / (10 * q)))


def close(x: np.ndarray, y: np.ndarray, similar: tuple[int, int]) -> bool:
    p, q = similar
    common = len(np.intersect1d(x, y, assume_unique=True))
    return q * common >= p * (len(x) + len(y) - common)


class Bucket:
    """Texts that share a shingle: those outside the largest known component are held, the others only pass by."""

    def __init__(self, similar: tuple[int, int], inside: bool):
        self.similar, self.inside = similar, inside  # inside: whether links among the held ones are asked for here
        self.nodes: list[int] = []
        self.roots: list[int] = []
        self.sets: list[np.ndarray] = []
        self.live: np.ndarray | None = None
        self.links: list[tuple[int, int]] = []

    def hold(self, node: int, root: int, own: np.ndarray) -> None:
        self.nodes.append(node)
        self.roots.append(root)
        self.sets.append(own)

    def found(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Those of the live ones that are similar to x."""
        p, q = self.similar
        n = self.sizes[live]
        near = live[q * np.minimum(n, len(x)) >= p * np.maximum(n, len(x))]
        if not len(near):
            return near
        every, n = np.concatenate([self.sets[i] for i in near]), self.sizes[near]
        hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
        return near[(p + q) * common >= p * (n + len(x))]

    def begin(self) -> None:
        """Links among the held ones; then one member of each of their components goes for all."""
        self.sizes, self.label = np.array([len(s) for s in self.sets], np.int64), np.array(self.roots, np.int64)
        self.live = np.arange(len(self.sets))
        if not self.inside:
            return
        left = self.live
        while len(left):
            group = left[self.label[left] == self.label[left[0]]].tolist()
            left = np.setdiff1d(left, group, assume_unique=True)
            k = 0
            while k < len(group) and len(left):
                for i in self.found(self.sets[group[k]], left).tolist():
                    if self.label[i] != self.label[group[0]]:
                        self.link(self.nodes[i], self.nodes[group[k]])
                        more = left[self.label[left] == self.label[i]]
                        self.label[more] = self.label[group[0]]
                        group += more.tolist()
                left = left[self.label[left] != self.label[group[0]]]
                k += 1

    def link(self, a: int, b: int) -> None:
        self.links.append((max(a, b), min(a, b)))

    def meet(self, node: int, own: np.ndarray) -> None:
        """A member of the largest component."""
        if self.live is None:
            self.begin()
        if len(self.live):
            for i in self.found(own, self.live).tolist():
                if i in self.live:
                    self.link(self.nodes[i], node)
                    self.live = self.live[self.label[self.live] != self.label[i]]

    def end(self) -> list[tuple[int, int]]:
        if self.live is None and self.sets:
            self.begin()
        return self.links


def pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    """(larger, smaller) as a batch of columns a and b."""
    a = np.array(rows, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def with_sets(texts: DataFrame, size: int) -> DataFrame:
    """texts (node, text binary) -> (node, hs: the whole set as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t or b"", size).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "hs"])

    return texts.select("node", "text").mapInArrow(run, "node long, hs binary")


#: Gives the texts (node, text binary) of a written table's nodes (node).
Fetch = Callable[[DataFrame], DataFrame]


def checked(found: DataFrame, fetch: Fetch, size: int, similar: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) found whose sets are similar."""
    ends = written(found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct(), "overlap-ends")
    sets = written(with_sets(fetch(ends), size), "overlap-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2):
            x, y = ([np.frombuffer(s, np.uint64) for s in b.column(k).to_pylist()] for k in (2, 3))
            yield b.select([0, 1]).filter(pa.array([close(s, t, similar) for s, t in zip(x, y, strict=True)], pa.bool_()))

    both = found.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hs").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def alive(prints: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(node) of those that may have a similar text. prints: (node, n: number of shingles, prefix: the first ones)."""
    # As few bits of a hash as tell shingles apart in all but a thousandth of the cases; more sharing does no harm.
    total = prints.agg(F.sum(F.size("prefix"))).first()[0] or 0
    mask = (1 << min(63, total.bit_length() + 10)) - 1
    rows = prints.select("node", F.explode(F.array_distinct(F.transform("prefix", lambda h: h.bitwiseAND(F.lit(mask))))).alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h")
    shared = rows.join(often, "h", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
    return shared.join(prints.select("node", "n"), "node").where(F.col("shared") >= least_shared(F.col("n"), similar)).select("node")


def links(fetch: Fetch, known: DataFrame, prints: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """Links (a, b), a > b, that join all similar texts, given what is known.

    known: (a, b), each node but the smallest of its component with that one. prints: as in `alive`.
    """
    p, q = similar
    some = written(alive(prints, similar), "overlap-alive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            sets = [shingles(t or b"", size) for t in b.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            nodes = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, sizes)), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64))], ["node", "n", "h"])

    # Shingles that one text alone holds come first in its order and lead nowhere, so only their number counts.
    rows = fetch(some).mapInArrow(run, "node long, n int, h long")
    own = rows.join(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "h")
    own = own.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    own = own.withColumn("k", F.expr(f"n - (n * {p} + {q} - 1) div {q} + 1 - (n - size(hs))")).where("k > 0")
    own = own.select("node", F.explode(F.expr("slice(hs, 1, cast(k as int))")).alias("x")).select("node", F.col("x.h").alias("h"))
    named = own.join(known.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "h")
    named = written(named, "overlap-prefixes")
    by_root = named.groupBy("h", "root").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.col("node").cast("decimal(38,0)")).alias("s"))
    buckets = by_root.groupBy("h").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"), F.max(F.struct("n", "root")).alias("most"))
    buckets = buckets.where("roots > 1").groupBy("n", "x", "s").agg(F.min(F.struct("h", "most")).alias("of"))
    buckets = buckets.select("of.h", F.col("of.most.root").alias("main"), F.expr(f"cast(ceil(of.most.n / {BLOCK}) as int)").alias("blocks"))
    members = named.join(buckets, "h").withColumn("big", F.col("root") == F.col("main"))
    own_block = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("block", F.explode(F.when(F.col("big"), own_block).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))).select("h", "block", "big", "node", "root")
    members = written(members, "overlap-buckets")
    sets = with_sets(fetch(written(members.select("node").distinct(), "overlap-members")), size)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, None
        for b in sliced(batches, 5):
            out = []
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            for key, big, node, root, s in zip(keys, *[b.column(k).to_pylist() for k in (2, 3, 4, 5)], strict=True):
                if key != at:
                    out += bucket.end() if bucket else []
                    at, bucket = key, Bucket(similar, key[1] == 0)
                if big:
                    bucket.meet(node, np.frombuffer(s, np.uint64))
                else:
                    bucket.hold(node, root, np.frombuffer(s, np.uint64))
            yield pairs(out)
        if bucket:
            yield pairs(bucket.end())

    joined = members.join(sets, "node").select("h", "block", "big", "node", "root", "hs")
    return joined.repartition("h", "block").sortWithinPartitions("h", "block", "big", "node").mapInArrow(compare, "a long, b long").distinct()
