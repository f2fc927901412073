"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched by beams.

Largest inner product becomes smallest distance by one more component that makes all norms of a shard equal. Equal
vectors are one node with its smallest ids, as many as a result can need, so copies neither bloat a shard nor the
graph. Nodes are dealt to shards of about `SHARD` by their hash. A shard's graph is built in batches: greedy beam
search from the medoid proposes neighbours for each new node, relaxed distance pruning keeps diverse ones (a
candidate goes if a kept neighbour is closer to it by the factor `ALPHA`), edges are added in both directions, and
nodes with too many are pruned alike. Graphs are written; each block of queries is searched in each shard, and the best
of all shards are kept. The tasks that search are a fixed number at most. All rows are indexed.

Scores are inner products in double precision on the vectors as stored.

Defined cases: rows with a null id, a null or zero vector, or one that holds null or non-finite components take no
part; nor do vectors whose length is not the most frequent one (of equally frequent ones, the longest). Rows that
repeat an id and vector are one; a query never finds its own id. Ties go to the smaller id. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.common import written

SHARD, BLOCK = 16_384, 2_048
#: Tasks that search, at most.
TASKS = 512
DEGREE, ALPHA, BUILD_BEAM, SEARCH_BEAM, EXPAND = 32, 1.2, 64, 100, 4


class Graph:
    """Vectors (float32, all of one norm) and out-edges, -1 where there is none."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, entry: int = 0):
        self.x, self.entry = x, entry
        self.edges = np.full((len(x), 2 * DEGREE), -1, np.int32) if edges is None else edges

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, products) of the best `beam` that a greedy search finds for each row of q, best first; -1 for none."""
        n, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((n, len(self.x) + 1), bool)
        seen[:, -1] = True  # where -1 points
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -np.inf, np.float32)
        done = np.ones((n, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0], seen[:, self.entry] = self.entry, q @ self.x[self.entry], False, True
        live = np.arange(n)
        while len(live):
            sub = rows[: len(live)]
            todo = np.argsort(done[live], axis=1, kind="stable")[:, :EXPAND]  # sorted by product: the best not expanded
            fresh = ~done[live[:, None], todo]
            at = np.where(fresh, ids[live[:, None], todo], -1)
            done[live[:, None], todo] = True
            near = np.where(at[:, :, None] >= 0, self.edges[at], -1).reshape(len(live), -1)
            near[seen[live[:, None], near]] = -1
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            width = int((near >= 0).sum(axis=1).max(initial=0))
            if width:
                near = -np.sort(-near, axis=1)[:, :width]
                seen[live[:, None], near] = True
                s = np.matmul(self.x[near], q[live][:, :, None])[:, :, 0]
                s[near < 0] = -np.inf
                all_s = np.concatenate([sims[live], s], axis=1)
                all_i = np.concatenate([ids[live], near], axis=1)
                all_d = np.concatenate([done[live], near < 0], axis=1)
                best = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
                ids[live], sims[live], done[live] = all_i[sub, best], all_s[sub, best], all_d[sub, best]
            live = live[~done[live].all(axis=1)]
        return ids, sims

    def prune(self, nodes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """DEGREE diverse neighbours of each node among its candidates (-1 for none)."""
        x, norm = self.x, float(self.x[0] @ self.x[0])
        found = np.where(found == nodes[:, None], -1, found)
        s = np.matmul(x[found], x[nodes][:, :, None])[:, :, 0]
        s[found < 0] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")
        found, s = np.take_along_axis(found, order, 1), np.take_along_axis(s, order, 1)
        dup = np.zeros_like(found, bool)
        dup[:, 1:] = found[:, 1:] == found[:, :-1]
        alive = (found >= 0) & ~dup
        far = np.maximum(2 * (norm - s), 0)  # squared distances to the node
        own, rows, out = x[found], np.arange(len(nodes)), np.full((len(nodes), DEGREE), -1, np.int32)
        for k in range(DEGREE):
            first = alive.argmax(axis=1)
            any_left = alive[rows, first]
            if not any_left.any():
                break
            out[any_left, k] = found[rows, first][any_left]
            apart = np.maximum(2 * (norm - np.matmul(own, own[rows, first][:, :, None])[:, :, 0]), 0)
            alive &= ALPHA * ALPHA * apart > far
            alive[rows, first] = False
        return out

    def connect(self, nodes: np.ndarray, out: np.ndarray) -> None:
        """Sets the out-edges of nodes and adds the edges back."""
        self.edges[nodes] = -1
        self.edges[nodes, :DEGREE] = out
        src, dst = np.repeat(nodes, DEGREE), out.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, start = np.unique(dst, return_index=True)
        rank = np.arange(len(dst)) - np.repeat(start, np.diff(np.append(start, len(dst))))
        have = (self.edges >= 0).sum(axis=1) if len(targets) > len(self.x) // 4 else None
        free = have[dst] if have is not None else (self.edges[dst] >= 0).sum(axis=1)
        fits = free + rank < self.edges.shape[1]
        self.edges[dst[fits], (free + rank)[fits]] = src[fits]
        full = np.unique(dst[~fits])
        for i in range(0, len(full), 512):
            part = full[i : i + 512]
            lo, hi = np.searchsorted(dst, part), np.searchsorted(dst, part, "right")
            extra = np.full((len(part), int((hi - lo).max())), -1, np.int32)
            for k, (a, b) in enumerate(zip(lo, hi, strict=True)):
                extra[k, : b - a] = src[a:b]
            kept = self.prune(part, np.concatenate([self.edges[part], extra], axis=1))
            self.edges[part] = -1
            self.edges[part, :DEGREE] = kept


def build(x: np.ndarray) -> Graph:
    """The graph of a shard, nodes coming in a fixed random order, in batches that grow with it."""
    g = Graph(x)
    n = len(x)
    g.entry = int((x @ x.mean(axis=0)).argmax())
    order = np.random.RandomState(7).permutation(n).astype(np.int32)
    order = np.concatenate([[g.entry], order[order != g.entry]]).astype(np.int32)
    at = min(n, 2 * DEGREE)
    first = order[:at]
    if at > 1:
        g.connect(first, g.prune(first, np.repeat(first[None, :], at, axis=0)))
    while at < n:
        batch = order[at : at + min(512, at)]
        ids, _ = g.search(x[batch], BUILD_BEAM)
        g.connect(batch, g.prune(batch, ids))
        at += len(batch)
    return g


def _usable(v: Column) -> Column:
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return v.isNotNull() & ok & F.exists(v, lambda c: c != 0)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which is_query holds (asked of vec_id)."""
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).where("vec_id IS NOT NULL").where(_usable(F.col("v")))
    dim = own.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    dim = dim.d if dim else 1
    own = own.where(F.size("v") == dim)
    # Only the k + 1 smallest ids of equal vectors can be among k results; the limit works before the shuffle too.
    ranked = own.distinct().withColumn("i", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    nodes = written(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-nodes")
    shards = max(1, -(-nodes.count() // SHARD))
    queries = own.where(is_query).distinct()
    blocks = max(1, -(-queries.count() // BLOCK))

    def graph(table: pa.Table) -> pa.Table:
        x = np.array(table.column("v").to_pylist(), np.float64)
        ids = table.column("ids").to_pylist()
        square = (x * x).sum(axis=1)
        a = np.concatenate([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1).astype(np.float32)
        g = build(a)
        flat = np.concatenate([np.array(i, np.int64) for i in ids])
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "entry": pa.array([g.entry], pa.int32()), "x": pa.array([x.tobytes()], pa.binary()),
            "extra": pa.array([a[:, -1].tobytes()], pa.binary()), "edges": pa.array([g.edges.tobytes()], pa.binary()),
            "ids": pa.array([flat.tobytes()], pa.binary()), "sizes": pa.array([np.array([len(i) for i in ids], np.int32).tobytes()], pa.binary())})

    shard = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard")
    graphs = written(nodes.select(shard, "v", "ids").groupBy("shard").applyInArrow(
        graph, "shard int, entry int, x binary, extra binary, edges binary, ids binary, sizes binary"), "ann-graphs")
    asked = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.struct("vec_id", "v").alias("q"))
    asked = asked.groupBy("block").agg(F.sort_array(F.collect_list("q")).alias("qs"))  # about BLOCK of them

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest of each query in all shards of this task; shards come one after the other, each with all blocks."""
        best: dict[tuple, list[tuple[float, int]]] = {}
        for b in batches:
            for i in range(b.num_rows):
                r = {name: b.column(name)[i].as_py() for name in ("block", "entry", "x", "extra", "edges", "ids", "sizes")}
                qs = b.column("qs")[i].values
                asking, y = qs.field("vec_id").to_pylist(), qs.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x = np.frombuffer(r["x"], np.float64).reshape(-1, dim)
                a = np.concatenate([x.astype(np.float32), np.frombuffer(r["extra"], np.float32)[:, None]], axis=1)
                g = Graph(a, np.frombuffer(r["edges"], np.int32).reshape(len(x), -1), r["entry"])
                sizes, flat = np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["ids"], np.int64)
                start = np.cumsum(sizes) - sizes
                for j in range(0, len(asking), 256):
                    q = y[j : j + 256]
                    found, _ = g.search(np.concatenate([q.astype(np.float32), np.zeros((len(q), 1), np.float32)], axis=1), max(SEARCH_BEAM, 2 * k))
                    for m, own_id in enumerate(asking[j : j + 256]):
                        near = found[m][found[m] >= 0][: 2 * k + 8]
                        s = (x[near] * q[m]).sum(axis=1)
                        hits = [(-float(s[n]), int(v)) for n, c in enumerate(near) for v in flat[start[c] : start[c] + sizes[c]] if v != own_id]
                        key = r["block"], j + m
                        best[key, own_id] = sorted(best.get((key, own_id), []) + hits)[:k]
        rows = [(q, v, -t) for (_, q), hits in best.items() for t, v in hits]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    # At most TASKS tasks, however many shards and blocks there are: a task has a slice of the blocks, which it holds,
    # and a part of the shards, which pass by. Nothing is shuffled but the blocks, once, and each task's results.
    slices = min(blocks, TASKS)
    asked = asked.repartitionById(slices, F.col("block") % slices)
    pairs = graphs.drop("shard").coalesce(TASKS // slices).crossJoin(asked.hint("shuffle_replicate_nl"))
    hits = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
