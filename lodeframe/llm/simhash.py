"""Near-duplicate documents by SimHash: fingerprints of word shingles, linked through BK-trees.

1. A fingerprint bit is the majority of that bit over the XXH64 hashes of a document's shingles.
2. Equal fingerprints are one node from there on (grouped with partial aggregation), so copies cost nothing more.
3. Fingerprints that differ in at most `radius` of 64 bits agree on at least `m - radius` of any m blocks. Each
   node is keyed by every choice of m - radius blocks; all links therefore lie within buckets of equal keys. m
   grows with the number of nodes, so that buckets stay small.
4. Each bucket is a shard with a BK-tree: children keyed by their Hamming distance to the parent, and only edges
   within the radius are followed. A search takes what it finds out of the tree, so a bucket gives spanning links,
   never all pairs. The trees are built where their bucket is, not broadcast, as nothing bounds their size. (One
   tree over all fingerprints would not scale: at radius 4 a search enters, on average of 40, 992 of 10,000 random
   fingerprints, 5,214 of 100,000 and 17,604 of 600,000, so the work would grow with about the power 1.7 of the table.)
5. Components come from alternating star contraction on DataFrames, each round written to the shared folder.

`dedup` is the form for pipelines: near copies are texts whose sets of five-word shingles have a Jaccard similarity of
0.8 or more. Links of fingerprints are candidates there, checked with the whole sets; as no radius that can be searched
holds all such pairs, `overlap` adds the rest, exactly, among texts that fingerprints have not linked already.

Defined cases: texts without words have fingerprint 0 and link like any other; null texts count as empty; very long
texts are read whole, their hashes counted in parts; rows that repeat an id share its component in `simhash_groups`, and
are judged each by its own text in `dedup`; ties go to the smallest id. Fingerprints that only rows without an id have
link to none; such rows have a null component unless another row with an id has the same fingerprint. Empty tables give
no rows; extra columns are not read, and `dedup` returns them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import overlap
from lodeframe.llm.common import SPACE, discard, hinted, sliced, written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Of `dedup`: words of a shingle, and the least Jaccard similarity as two whole numbers.
WORDS, SIMILAR = 5, (4, 5)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of the whole text; bytes.split() parts at exactly the ASCII white space."""
    import xxhash

    ws = text.lower().split()
    if not ws:
        return 0
    hashed, line = xxhash.xxh64_intdigest, b" ".join(ws)
    if len(ws) <= shingle:
        return hashed(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = [0, *(ends[: len(ws) - shingle] + 1).tolist()]
    return majority(np.array([hashed(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A BK-tree over integers whose searches remove what they find; spent branches are not entered again."""

    def __init__(self, values: list[int]):
        self.values, self.parent = values, [-1] * len(values)
        self.children: list[dict[int, int]] = [{} for _ in values]
        self.live, self.there = [1] * len(values), [True] * len(values)
        for i in range(1, len(values)):
            x, at = values[i], 0
            while True:
                self.live[at] += 1
                d = (x ^ values[at]).bit_count()
                if (nxt := self.children[at].get(d)) is None:
                    self.children[at][d], self.parent[i] = i, at
                    break
                at = nxt

    def drop(self, i: int) -> None:
        self.there[i] = False
        while i >= 0:
            self.live[i] -= 1
            i = self.parent[i]

    def take(self, x: int, radius: int) -> list[int]:
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            if not self.live[at]:
                continue
            d = (x ^ self.values[at]).bit_count()
            if d <= radius and self.there[at]:
                found.append(at)
            stack += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        for i in found:
            self.drop(i)
        return found


def spanning(values: list[int], ids: list[int], radius: int) -> list[tuple[int, int]]:
    """Pairs (larger id, smaller id) within the radius that join the components of one bucket."""
    tree, out = BKTree(values), []
    for i in range(len(values)):
        if tree.there[i]:
            tree.drop(i)
            group, k = [i], 0
            while k < len(group):
                found = tree.take(values[group[k]], radius)
                out += [(max(ids[g], ids[group[k]]), min(ids[g], ids[group[k]])) for g in found]
                group += found
                k += 1
    return out


def _keys(n: int, radius: int) -> list[int]:
    """Masks of the block choices: the fewest blocks for which a bucket of n spread fingerprints stays small."""
    m = next((m for m in range(radius + 1, radius + 4) if n >> (64 * (m - radius) // m) <= 64), radius + 4)
    cuts = [64 * k // m for k in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (a, b), a > b, of nodes (fp, id) within the radius."""
    masks = _keys(nodes.count(), radius)
    keyed = nodes.select("fp", "id", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(x))) for x in masks])).alias("k", "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # what there is of the bucket that may go on

        def bucket() -> list[tuple[int, int]]:
            fps, ids = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            held.clear()
            return spanning(fps.view(np.uint64).tolist(), ids.tolist(), radius) if len(ids) > 1 else []

        last = None
        for b in batches:
            fp, ident, k, key = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(k):
                continue
            rows = bucket() if held and last != (k[0], key[0]) else []
            edges = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), len(k)]
            for i, j in zip(edges, edges[1:], strict=False):
                held.append((fp[i:j], ident[i:j]))
                if j < len(k):
                    rows += bucket()
            last = k[-1], key[-1]
            yield overlap.pairs(rows)
        if held:
            yield overlap.pairs(bucket())

    found = keyed.repartition("k", "key").sortWithinPartitions("k", "key", "id").mapInArrow(run, "a long, b long")
    return found.distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b): every node but the smallest of each component with that smallest one. edges: (a, b), a > b."""
    edges, before = written(edges, name), None
    while True:
        size = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if size[0] == 0 or tuple(size) == before:
            return edges
        before = tuple(size)
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        after = written(small.where("a <> b").distinct(), name)
        discard(edges)
        edges = after


def simhash_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest id of its component)."""
    fps = written(fingerprints(docs, doc_id, text, shingle), "simhash")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    roots = components(links(nodes.where("id IS NOT NULL"), radius), "simhash-links")
    of_fp = nodes.join(roots.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left")
    return fps.join(of_fp.select("fp", F.coalesce("root", "id").alias("component_id")), "fp", "left").select("doc_id", "fp", "component_id")


def prints(texts: DataFrame, size: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """texts (id, text binary) -> (id, words: hash of the text's words, fp, n: how many shingles, prefix: the first ones
    in the order of their hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            texts = [t or b"" for t in b.column(1).to_pylist()]
            sets = [overlap.shingles(t, size) for t in texts]
            words = [hashlib.md5(b" ".join(t.lower().split())).digest() for t in texts]
            fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            prefix = [s[: overlap.first_ones(len(s), similar)].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(words, pa.binary()), pa.array(fps), pa.array([len(s) for s in sets], pa.int32()), pa.array(prefix, pa.list_(pa.int64()))], ["id", "words", "fp", "n", "prefix"])

    return texts.mapInArrow(run, "id long, words binary, fp long, n int, prefix array<long>")


def near_links(nodes: DataFrame, fetch: overlap.Fetch, size: int = WORDS, similar: tuple[int, int] = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(a, b): near copies among nodes (node, fp, n, prefix), each but the smallest of its component with that one."""
    fps = written(nodes.groupBy("fp").agg(F.min("node").alias("id")), "near-prints")
    same = nodes.select("node", "fp").join(fps, "fp").where("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    found = written(links(fps, radius).union(same), "near-candidates")
    near = written(overlap.checked(found, fetch, size, similar), "near-checked")
    return components(near.union(overlap.links(fetch, components(near, "near-known"), nodes, size, similar)), "near-links")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies; all columns stay.

    Rows without an id stay, as nothing tells them apart. Rows that repeat an id are judged each by its own text.
    """
    none, some = docs.where(F.col(doc_id).isNull()), docs.where(F.col(doc_id).isNotNull())
    plain = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.unhex(F.md5(F.btrim(F.regexp_replace(plain, SPACE, F.lit(" "))).cast("binary")))
    seen = written(prints(some.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))), "near-seen")
    repeats = not seen.groupBy("id").count().where("count > 1").isEmpty()
    key = ["id", "words"] if repeats else ["id"]
    if repeats:
        seen = written(seen.dropDuplicates(key), "near-seen")
    # Texts of the same words are one node, whose number is settled once the table is written.
    nodes = written(seen.groupBy("words").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    def rows() -> DataFrame:
        own = some.select(F.col(doc_id).cast("long").alias("id"), F.struct(*docs.columns).alias("row"))
        if not repeats:
            return own
        return some.select(F.col(doc_id).cast("long").alias("id"), words.alias("words"), F.struct(*docs.columns).alias("row")).dropDuplicates(key)

    def fetch(of: DataFrame) -> DataFrame:
        own = written(nodes.join(hinted(of), "node"), "near-wanted")
        return rows().join(hinted(own), key).select("node", F.col(f"row.`{text}`").cast("binary").alias("text"))

    own = written(seen.join(hinted(nodes), ["words", "id"]).select("node", "fp", "n", "prefix"), "near-own")
    gone = near_links(own, fetch, **more)
    groups = gone.unionByName(gone.select(F.col("b").alias("a"), "b").distinct()).join(nodes.select(F.col("node").alias("a"), "id"), "a")
    first = groups.groupBy("b").agg(F.min_by("a", F.struct("id", "a")).alias("a"))
    lost = nodes.join(groups.join(first, ["b", "a"], "left_anti").select(F.col("a").alias("node")), "node", "left_semi").select("words", "id")
    # Rows that go: those of such nodes, and copies of words that another id stands for.
    copies = seen.select("words", "id").join(nodes.select("words", "id"), ["words", "id"], "left_anti")
    out = rows().join(hinted(written(lost.union(copies).select(*key), "near-lost")), key, "left_anti")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).unionByName(none)


def op4(spark, sf_dir: str) -> DataFrame:
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
