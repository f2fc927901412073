"""Language-model scoring with a probabilistic suffix tree.

Symbols are the frequent words, one class per frequent word ending for all other words, and the end of a text. The
next symbol depends on up to `DEPTH` symbols before it, as far back as the tree holds them:

1. Contexts that have at least `LEAST` of all symbols are frequent; there are at most 1 / LEAST of them on a level.
   They are found in two passes: a frequent context is heavy in some chunk of the texts, and the heavy ones are
   then counted with what follows them. All followers from `SEEN` occurrences on are kept one by one. This part of the
   tree is broadcast. It holds `FOLLOWERS` of them at most: where there are more, the least frequent of these contexts
   are not treated as frequent but as the others.
2. All other contexts are states too from `SEEN` occurrences on, and their number grows with the corpus. Nothing holds
   them all: each place of a text goes, with the symbols before it, to the partition of its shortest context that
   is not frequent. All longer contexts of that place are there too, so a partition builds its branches of the tree
   and scores its places by them.
3. A context stays if its next-symbol distribution diverges from that of its longest suffix: count times Kullback-
   Leibler divergence, a likelihood ratio, of `DIVERGENCE` nats or more.
4. A distribution is smoothed towards that of the longest suffix that stayed, with as many counts as there are
   kinds of followers (and those of a frequent context's followers that were seen less often); so it sums to one.
5. Each symbol is scored by the state of the longest suffix. A word of a class has its share of the class; all
   unknown words together have the share of what the class was seen with only once.

Counts of words are a table (word, count) that all documents are aggregated into. Words among the `HEAD` most
frequent are added up where the texts are read; the others go through a join, so nothing of unbounded size is
broadcast.

Defined cases: null and empty texts have the end token alone. Very long texts are read whole, in one piece. Repeated
rows are scored each on its own. A null id is neither learned from nor held out. Words of equal counts are put in the
order of their bytes. Extra columns are not read. With nothing to learn from, all words are unknown and the base score
is 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import crc_mod, sliced, written

DEPTH, LEAST, SEEN, DIVERGENCE = 5, 1e-4, 2, 6.0
#: Followers of frequent contexts that are broadcast, at most; they take about 32 bytes each.
FOLLOWERS = 2_000_000
#: Words and endings with so large a share of the learned words are symbols of their own.
FREQUENT, ENDING, HEAD = 1e-4, 2, 300_000
#: Of a symbol; NONE stands before a text's beginning, which itself counts as an END.
BITS, END, OTHER = 15, 0, 1
NONE = (1 << BITS) - 1
#: Places that a partition of the tree is to have, at most on average, and symbols of a chunk.
PLACES, CHUNK = 1_000_000, 400_000
#: Symbols before a place that are packed into one number; the others into a second one.
PACKED = 4


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words (binary) of some binary texts, one after the other, and the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    words, doc = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty one
    if not real.all():
        words, doc = words.filter(pa.array(real)), doc[real]
    return words.view(pa.binary()), doc


def vocabulary(docs: DataFrame) -> DataFrame:
    """docs (text binary, learn boolean) -> (word binary, c: times in learned texts, a: times in all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def added() -> pa.Table:
            whole = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum"), ("a", "sum")])
            return whole.select(["word", "c_sum", "a_sum"]).rename_columns(["word", "c", "a"])

        for b in sliced(batches, 0):
            words, doc = tokens(b.column(0))
            own, learn = words.dictionary_encode(), b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            at, n = own.indices.to_numpy(), len(own.dictionary)
            c = np.bincount(at, learn[doc], n).astype(np.int64)
            held.append(pa.table([own.dictionary, pa.array(c), pa.array(np.bincount(at, minlength=n).astype(np.int64))], ["word", "c", "a"]))
            if sum(map(len, held)) > 300_000:
                held = [added()]
                if len(held[0]) > 150_000:
                    yield from held.pop().to_batches(max_chunksize=10_000)
                pa.default_memory_pool().release_unused()
        if held:
            yield from added().to_batches(max_chunksize=10_000)
            held.clear()
        pa.default_memory_pool().release_unused()

    return docs.select("text", "learn").mapInArrow(run, "word binary, c long, a long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


@dataclass
class Alphabet:
    """words: symbols of the frequent words, from 2 on; endings: those of the classes."""

    words: dict[bytes, int]
    endings: dict[bytes, int]

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        words, endings = self.words, self.endings
        return np.fromiter((words[w] if w in words else endings.get(w[-ENDING:], OTHER) for w in tokens), np.int64, len(tokens))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))).view(np.int64)


def windows(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(near, far): the PACKED symbols before each symbol of joined texts, the last one on top, and those before these.

    first: distance of each symbol from its text's start.
    """
    out = [np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)]
    for k in range(1, DEPTH + 1):
        before = np.concatenate([np.full(k, END, np.int64), s[:-k]]) if k < len(s) else np.full(len(s), END, np.int64)
        before[first == k - 1] = END
        before[first < k - 1] = NONE
        out[k > PACKED] = out[k > PACKED] << BITS | before
    return out[0] << BITS * max(0, PACKED - DEPTH), out[1]


def context(near: np.ndarray, far: np.ndarray, depth: int) -> np.ndarray:
    """A number for the last `depth` symbols."""
    if depth <= PACKED:
        return near >> BITS * (PACKED - depth)
    return _mixed(near ^ _mixed(far >> BITS * (DEPTH - depth)))


def last_of(near: np.ndarray, far: np.ndarray, depth: int) -> np.ndarray:
    """The symbol `depth` places before."""
    return (near >> BITS * (PACKED - depth) if depth <= PACKED else far >> BITS * (DEPTH - depth)) & NONE


def cut(near: np.ndarray, far: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Without the symbols that are further away."""
    n, f = BITS * max(0, PACKED - depth), BITS * min(DEPTH - PACKED, DEPTH - depth)
    return near >> n << n, far >> f << f


def _follower(ctx: np.ndarray, s: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(ctx) + s)


class Keys:
    """Sorted numbers of 64 bits that `_mixed` has spread: those with some first bits begin at a place known for each."""

    def __init__(self, x: np.ndarray):
        self.x, self.bits = np.append(x, np.iinfo(np.int64).max), max(1, len(x).bit_length())
        self.begin = np.searchsorted(x, np.arange(-(1 << self.bits - 1), 1 << self.bits - 1) << 64 - self.bits).astype(np.int32)

    def __reduce__(self):
        return Keys, (self.x[:-1],)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of x, one more than there are at most, and whether they are there."""
        at = self.begin[(x >> 64 - self.bits) + (1 << self.bits - 1)]
        less = np.flatnonzero(self.x[at] < x)
        while len(less):
            at[less] += 1
            less = less[self.x[at[less]] < x[less]]
        return at, self.x[at] == x


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of x: its distinct values, sorted; a place of each; and which one each place has."""
    order = np.argsort(x)
    y = x[order]
    new = np.concatenate([[True], y[1:] != y[:-1]])
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return y[new], order[new], which


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their numbers, of sorted ones."""
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[start], np.diff(np.append(start, len(x)))


@dataclass
class Level:
    """Frequent contexts of one depth; weight: of the shorter state, 1 where the context did not stay; followers; share: of
    those, and 0 for what is none."""

    contexts: Keys
    weight: np.ndarray
    followers: Keys
    share: np.ndarray


@dataclass
class SuffixTree:
    """The frequent part of the tree."""

    root: np.ndarray
    levels: list[Level] = field(default_factory=list)

    def probability(self, near: np.ndarray, far: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each symbol by the longest frequent context; and the depth of the shortest context that is not frequent."""
        p, depth, on = self.root[s], np.ones(len(s), np.int8), np.arange(len(s))
        for d, level in enumerate(self.levels, 1):
            ctx = _mixed(context(near[on], far[on], d))
            at, there = level.contexts.find(ctx)
            on, at, ctx = on[there], at[there], ctx[there]
            depth[on] = d + 1
            e, known = level.followers.find(_mixed(ctx + s[on]))
            p[on] = np.where(known, level.share[e], 0.0) + level.weight[at] * p[on]
        return p, depth


@dataclass
class Chunk:
    """Texts as symbols, joined; sizes: of each text with its end."""

    sizes: np.ndarray
    s: np.ndarray

    def __post_init__(self):
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first = np.arange(len(self.s)) - np.repeat(self.starts, self.sizes)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers of 16 bits, their bytes apart, compressed."""
    x = x.astype("<u2").view(np.uint8).reshape(-1, 2)
    return pa.compress(np.ascontiguousarray(x.T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(pa.decompress(data, decompressed_size=2 * n, codec="zstd", asbytes=True), np.uint8).reshape(2, n)
    return np.ascontiguousarray(x.T).view("<u2").ravel()


def _chunks(batches: Iterator[pa.RecordBatch], learned: bool) -> Iterator[tuple[Chunk, np.ndarray, int]]:
    """(chunk, learn of each text, rid of the first text) from rows (rid, size, learn, symbols); learned: learned texts alone."""
    for b in batches:
        for rid, sizes, learn, data in zip(*[b.column(k) for k in range(4)], strict=True):
            n, ok = (x.values.to_numpy(zero_copy_only=False) for x in (sizes, learn))
            chunk, ids = Chunk(n.astype(np.int64), unpack(data.as_py(), int(n.sum())).astype(np.int64)), rid.as_py()
            if learned and not ok.all():
                keep = np.repeat(ok, n)
                chunk = Chunk(chunk.sizes[ok], chunk.s[keep])
            if len(chunk.s):
                yield chunk, ok, ids


def learn_tree(texts: DataFrame, root: np.ndarray, total: int) -> SuffixTree:
    """The frequent part, from rows (rid, size, learn, symbols); root: shares of the symbols; total: how many were learned."""
    sc, tree = texts.sparkSession.sparkContext, SuffixTree(root)
    least = max(8.0, LEAST * total)
    names = ["depth", "near", "far", "s", "n"]

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names)

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts with half the share that is asked for, within a chunk."""
        for chunk, _, _ in _chunks(batches, True):
            near, far = windows(chunk.s, chunk.first)
            parts, low, back = [], LEAST / 2 * len(near), np.sort(near)
            for d in range(1, min(DEPTH, PACKED) + 1):  # shorter contexts are beginnings of longer ones
                cut_off = BITS * (PACKED - d)
                ctx, n = _counted(back >> cut_off)
                ok = (n >= low) & (ctx & NONE != NONE)
                parts.append((np.full(int(ok.sum()), d), ctx[ok] << cut_off, np.zeros(int(ok.sum())), np.zeros(int(ok.sum())), n[ok]))
                heavy_ones = ctx[ok]
            on = Keys(np.sort(_mixed(heavy_ones))).find(_mixed(near))[1] if DEPTH > PACKED else np.zeros(len(near), bool)
            near, far = near[on], far[on]  # a longer context is heavy only if the shorter one is
            for d in range(PACKED + 1, DEPTH + 1):
                if not len(near):
                    break
                _, at, which = _distinct(context(near, far, d))
                n = np.bincount(which)
                ok = (n >= low) & (last_of(near[at], far[at], d) != NONE)
                x, y = cut(near[at[ok]], far[at[ok]], d)
                parts.append((np.full(len(x), d), x, y, np.zeros(len(x)), n[ok]))
                on = ok[which]
                near, far = near[on], far[on]
            yield rows(parts)

    schema = "depth long, near long, far long, s long, n long"
    found = texts.mapInArrow(heavy, schema).groupBy("depth", "near", "far").agg(F.sum("n").alias("n"))
    got = found.where(F.col("n") >= LEAST / 2 * total).toArrow()  # at most 2 / LEAST of each depth
    depth, near, far = (got.column(k).to_numpy() for k in range(3))
    asked = [Keys(np.sort(_mixed(context(near[depth == d], far[depth == d], d)))) for d in range(1, DEPTH + 1)]
    shared = sc.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _ in _chunks(batches, True):
            s, (near, far), parts = chunk.s, windows(chunk.s, chunk.first), []
            for d, among in enumerate(shared.value, 1):
                ctx = context(near, far, d)
                there = among.find(_mixed(ctx))[1]
                s, near, far, ctx = s[there], near[there], far[there], ctx[there]
                if not len(s):
                    break
                if d < PACKED:  # with its follower a context is one number still
                    key, n = _counted(np.sort(ctx << BITS | s))
                    parts.append((np.full(len(key), d), key >> BITS << BITS * (PACKED - d), np.zeros(len(key)), key & NONE, n))
                else:
                    _, at, which = _distinct(_follower(ctx, s))
                    parts.append((np.full(len(at), d), *cut(near[at], far[at], d), s[at], np.bincount(which)))
            yield rows(parts)

    n = written(texts.mapInArrow(count, schema).groupBy("depth", "near", "far", "s").agg(F.sum("n").alias("n")), "lm-contexts")
    often = n.groupBy("depth", "near", "far").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.count_if(F.col("n") >= SEEN).alias("own"))
    got = often.where(F.col("total") >= least).toArrow().sort_by([("total", "descending")])  # at most 1 / LEAST of each depth
    own, of = (got.column(k).to_numpy() for k in ("own", "total"))
    fit = int(np.searchsorted(np.cumsum(own), FOLLOWERS, "right"))
    if fit < len(of):  # equal ones are treated alike, so shorter contexts stay with longer ones
        fit = int((of > of[fit]).sum())
    got = got.slice(0, fit)
    depth, near, far, of, kinds = (got.column(k).to_numpy() for k in ("depth", "near", "far", "total", "kinds"))
    held = got.select(["depth", "near", "far"]).append_column("id", pa.array(np.arange(fit, dtype=np.int32)))
    held = texts.sparkSession.createDataFrame(held) if fit else n.where("false").withColumn("id", F.lit(0)).drop("s", "n")
    got = n.where(F.col("n") >= SEEN).join(F.broadcast(held), ["depth", "near", "far"]).select("id", F.col("s").cast("short"), "n").toArrow()  # bounded by FOLLOWERS
    ids, s, k = (got.column(i).to_numpy() for i in range(3))
    for d in range(1, DEPTH + 1):
        on = np.flatnonzero(depth == d)
        if not len(on):
            break
        ctx = _mixed(context(near[on], far[on], d))
        order = np.argsort(ctx)
        on, ctx = on[order], ctx[order]
        place = np.full(fit, -1)
        place[on] = np.arange(len(on))
        mine = np.flatnonzero(depth[ids] == d)
        at, follower, times = place[ids[mine]], s[mine].astype(np.int64), k[mine]
        below = tree.probability(near[on][at], far[on][at], follower)[0]
        size, more = of[on], kinds[on]
        weight = (size - np.bincount(at, times, len(on)) + more) / (size + more)
        share = times / (size + more)[at]
        p = share + weight[at] * below
        stays = np.bincount(at, times * np.log(p / below), len(on)) >= DIVERGENCE
        keep = stays[at]
        followers = _mixed(ctx[at[keep]] + follower[keep])
        order = np.argsort(followers)
        tree.levels.append(Level(Keys(ctx), np.where(stays, weight, 1.0), Keys(followers[order]), np.append(share[keep][order], 0.0)))
    return tree


def branches(tree: SuffixTree, near: np.ndarray, far: np.ndarray, s: np.ndarray, learn: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """log10 of what the longest states change about the frequent part's probabilities of the symbols s, at places in the
    order of `near`. depth: of their shortest contexts that are not frequent; learn: 1.0 where a place is learned from."""
    p, before = np.ones(len(s)), np.ones(len(s))
    alive = np.zeros(len(s), bool)  # the context before was seen often enough
    for d in range(1, DEPTH + 1):
        on = np.flatnonzero((alive | (depth == d)) & (last_of(near, far, d) != NONE))
        alive[:] = False
        if not len(on):
            continue
        ctx = context(near[on], far[on], d)
        # Neighbours, as the places are in order, but for symbols that are too far away for it.
        group = np.concatenate([[0], np.cumsum(ctx[1:] != ctx[:-1])]) if d <= PACKED else _distinct(ctx)[2]
        often = np.bincount(group, learn[on])[group] >= SEEN
        on, group = on[often], group[often]
        if not len(on):
            continue
        alive[on] = True
        pair, at, inv = _distinct(group << BITS | s[on])
        at = on[at]
        # Places of one context and symbol agree in all that is shorter, so what is below is asked for once.
        below, fresh = p[at], depth[at] == d
        below[fresh] = tree.probability(near[at[fresh]], far[at[fresh]], s[at[fresh]])[0]
        k, of = np.bincount(inv, learn[on]), pair >> BITS
        kinds = np.bincount(of, k > 0)
        size = (np.bincount(of, k) + kinds)[of]
        new = k / size + kinds[of] / size * below
        gain = np.bincount(of, k * np.log(new / below))
        first = depth[on] == d
        before[on[first]] = below[inv[first]]
        p[on] = np.where(gain[of] >= DIVERGENCE, new, below)[inv]
    return np.log10(p / before)


def tree_scores(texts: DataFrame, tree: SuffixTree, total: int) -> DataFrame:
    """(rid, score) of each text, from rows (rid, size, learn, symbols)."""
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PLACES))
    shared = spark.sparkContext.broadcast(tree)  # bounded by LEAST and FOLLOWERS
    fields = {"part": "int", "rid": "long", "n": "int", "doc": "binary", "learn": "binary", "s": "binary", "back": "array<binary>"}
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, learn, rid in _chunks(batches, False):
            near, far = windows(chunk.s, chunk.first)
            p, depth = shared.value.probability(near, far, chunk.s)
            score = np.add.reduceat(np.log10(p), chunk.starts)
            # Scores by the frequent part go along, with no places.
            rows = [(rid % parts, rid, 0, score.tobytes(), None, None, None)]
            part = np.full(len(p), -1, np.int64)
            for d in range(1, DEPTH + 1):
                on = np.flatnonzero(depth == d)
                on = on[last_of(near[on], far[on], d) != NONE]
                part[on] = (_mixed(context(near[on], far[on], d)) >> 8) % parts
            on = np.flatnonzero(part >= 0)
            on = on[np.argsort(part[on].astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")]
            part, own, near, far = part[on], chunk.s[on].astype(np.uint16), near[on], far[on]
            back = [last_of(near, far, i).astype(np.uint16) for i in range(1, DEPTH + 1)]
            # Texts of a part are in order; how far it is to the next one, and the depth in the last 3 bits.
            doc = np.repeat(np.arange(len(learn)), chunk.sizes)[on]
            step = np.diff(doc, prepend=0)
            edge = np.flatnonzero(np.diff(part, prepend=-1))
            step[edge] = doc[edge]
            step = step << 3 | depth[on]
            ok = np.packbits(learn).tobytes()
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(on)], strict=True):
                rows.append((int(part[a]), rid, b - a, pack(step[a:b]), ok, pack(own[a:b]), [pack(x[a:b]) for x in back]))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], list(fields))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Branches of one part; scores go back to the chunks that the places came from."""
        held, rids, starts, at = [[] for _ in range(6)], [], [], 0

        def result(rid: int, docs: np.ndarray, scores: np.ndarray) -> tuple:
            return rid, pa.compress(docs.astype(np.uint16).tobytes(), codec="zstd", asbytes=True), len(docs), scores.tobytes()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.binary(), pa.int32(), pa.binary()], strict=True)], ["rid", "doc", "n", "score"])

        for b in batches:
            done = []
            for row in range(b.num_rows):
                _, rid, n, step, ok, own, back = (b.column(k)[row].as_py() for k in range(7))
                if not n:
                    scores = np.frombuffer(step, np.float64)
                    done.append(result(rid, np.arange(len(scores)), scores))
                    continue
                step, near, far = unpack(step, n), np.zeros(n, np.int64), np.zeros(n, np.int64)
                doc = np.cumsum(step >> 3)
                for i, x in enumerate(back):
                    x = unpack(x, n).astype(np.int64)
                    if i < PACKED:
                        near |= x << BITS * (PACKED - 1 - i)
                    else:
                        far = far << BITS | x
                learn = np.unpackbits(np.frombuffer(ok, np.uint8))[doc]
                for to, x in zip(held, (near, far.astype(np.int32) if (DEPTH - PACKED) * BITS < 31 else far, unpack(own, n), learn, (step & 7).astype(np.int8), (doc + at).astype(np.int32)), strict=True):
                    to.append(x)
                rids.append(rid)
                starts.append(at)
                at += int(doc[-1]) + 1
            yield batch(done)
        if not at:
            return
        whole = []
        while held:
            whole.append(np.concatenate(held.pop(0)))
        near, far, s, learn, depth, doc = whole
        order = np.argsort(near)
        change = branches(shared.value, near[order], far[order].astype(np.int64), s[order].astype(np.int64), learn[order].astype(np.float64), depth[order])
        score = np.bincount(doc[order], change, at)
        done, edges = [], [*starts[1:], at]
        for rid, a, b in zip(rids, starts, edges, strict=True):
            if len(on := np.flatnonzero(score[a:b])):
                done.append(result(rid, on, score[a:b][on]))
        yield batch(done)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of a chunk's texts, from all parts."""

        def batch(rid: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rid + np.arange(len(total))), pa.array(total)], ["rid", "score"])

        now, total = None, np.zeros(0)
        for b in batches:
            for rid, doc, n, own in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if rid != now:
                    if now is not None:
                        yield batch(now, total)
                    now, total = rid, np.zeros(0)
                docs = np.frombuffer(pa.decompress(doc, decompressed_size=2 * n, codec="zstd", asbytes=True), np.uint16)
                if len(docs) and (need := int(docs[-1]) + 1) > len(total):
                    total = np.concatenate([total, np.zeros(need - len(total))])
                total[docs] += np.frombuffer(own, np.float64)
        if now is not None:
            yield batch(now, total)

    dealt = texts.mapInArrow(deal, ", ".join(f"{k} {t}" for k, t in fields.items())).repartitionById(parts, F.col("part"))
    grown = dealt.mapInArrow(grow, "rid long, doc binary, n int, score binary")
    return grown.repartition("rid").sortWithinPartitions("rid").mapInArrow(add, "rid long, score double")


def score(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """docs (doc_id, text, learn, held_out) -> one row per document with token counts, base score and score."""
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"), "learn", "held_out")
    sc = docs.sparkSession.sparkContext
    vocab = written(vocabulary(docs), "lm-vocabulary")
    ends = docs.where("learn").count()
    first = vocab.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = first[0] + ends, first[1] + (ends > 0)
    least = max(1.0, FREQUENT * first[0])
    # The frequent words first: small numbers pack well.
    words = [(bytes(r.word), r.c) for r in vocab.where(F.col("c") >= least).orderBy(F.col("c").desc(), "word").limit(int(1 / FREQUENT)).select("word", "c").toLocalIterator()]
    plain = vocab.where("c > 0").withColumn("ending", F.expr(f"substring(word, -{ENDING}, {ENDING})"))
    ends_of = plain.groupBy("ending").agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once"))  # at most 65,792 endings
    endings = {bytes(r.ending): [r.c, r.once] for r in ends_of.toLocalIterator()}
    for w, c in words:
        endings[w[-ENDING:]][0] -= c
        endings[w[-ENDING:]][1] -= c == 1
    alphabet = Alphabet({w: i + 2 for i, (w, _) in enumerate(words)}, {})
    symbols = [float(ends), 0.0, *[float(c) for _, c in words]]
    classes = {OTHER: [0, 0]}
    for e, (c, once) in sorted(endings.items(), key=lambda x: (-x[1][0], x[0])):
        if c >= least:
            classes[len(symbols)] = [c, once]
            alphabet.endings[e] = len(symbols)
            symbols.append(float(c))
        else:
            classes[OTHER][0] += c
            classes[OTHER][1] += once
            symbols[OTHER] += c
    root = (np.array(symbols) + 0.5) / (total + 0.5 * len(symbols))
    # log10 shares, within a symbol, of one count and of all unknown words; a frequent word is all of its symbol.
    one, unknown = np.zeros(len(symbols)), np.zeros(len(symbols))
    for i, (c, once) in classes.items():
        new = (once + 1) / (c + 2)
        one[i], unknown[i] = math.log10((1 - new) / c) if c else 0.0, math.log10(new)
    shared = sc.broadcast((alphabet, one, unknown))  # bounded by FREQUENT
    floor = math.log10(total + distinct + 1)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, one, unknown = shared.value
        for b in batches:
            ws, c = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            s = own.ids(ws)
            frequent = (s >= 2) & (s < 2 + len(own.words))
            p = np.where(frequent, 0.0, np.where(c > 0, one[s] + np.log10(np.maximum(c, 1)), unknown[s]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(p, pa.float64())], ["word", "c", "a", "p"])

    with_shares = lambda words: words.select("word", "c", "a").mapInArrow(share, "word binary, c long, a long, p double")
    # The most frequent words by eighths of a doubling, as many whole bins as fit into `head`; nothing is sorted.
    of_bin, room, low = F.floor(F.log2("a") * 8), head, 1 << 20
    for r in sorted(vocab.groupBy(of_bin.alias("bin")).count().collect(), reverse=True):
        room -= r[1]
        if room < 0:
            break
        low = r.bin
    top = with_shares(vocab.where(of_bin >= low)).select("word", "c", "p").toArrow()
    ws = top.column(0).to_pylist()
    small = sc.broadcast((ws, top.column(1).to_numpy(), top.column(2).to_numpy(), alphabet.ids(ws).astype(np.int16)))  # at most `head` words
    n_end, base_end = int(ends > 0), math.log10(ends + 1) - floor

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, c, p, symbol = small.value
        own = shared.value[0]
        index = {w: i for i, w in enumerate(ws)}
        base, is_known = np.log10(c + 1.0) - floor, (c > 0).astype(np.float64)
        # One more place, for words that are not among them.
        base, is_known, p, symbol = np.append(base, 0.0), np.append(is_known, 0.0), np.append(p, 0.0), np.append(symbol.astype(np.int64), 0)
        rid = TaskContext.get().partitionId() << 40
        for b in sliced(batches, 1, CHUNK * 6):
            words, doc = tokens(b.column(1))
            n = b.num_rows
            sizes, each = np.bincount(doc, minlength=n), words.dictionary_encode()
            # Each distinct word is looked up once.
            ws, at = each.dictionary.to_pylist(), each.indices.to_numpy()
            place = np.fromiter(map(index.get, ws, repeat(-1)), np.int64, len(ws))
            s, new = symbol[place], np.flatnonzero(place < 0)
            s[new] = own.ids([ws[i] for i in new.tolist()])
            s, at = s[at], place[at]
            rare = np.flatnonzero(at < 0)
            # Each text's symbols with its end.
            whole = np.full(len(doc) + n, END, np.int64)
            whole[np.arange(len(doc)) + doc] = s
            per_doc = lambda x: np.bincount(doc, x[at], n)
            lists = [(b.column(0), pa.int64()), (b.column(2), pa.bool_()), (b.column(3), pa.bool_()), (sizes + 1, pa.int32()), (per_doc(is_known).astype(np.int64) + n_end, pa.int64()),
                     (per_doc(base) + base_end, pa.float64()), (per_doc(p), pa.float64()), (doc[rare], pa.int32()), (words.take(pa.array(rare)), pa.binary())]
            cols = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t)) for x, t in lists]
            yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([pack(whole)], pa.binary()), *cols], ["rid", "symbols", *kinds])
            rid += n
        pa.default_memory_pool().release_unused()

    kinds = {"doc_id": "long", "held_out": "boolean", "learn": "boolean", "size": "int", "known": "long", "base": "double", "p": "double", "of": "int", "word": "binary"}
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out", "learn")
    own = written(own.mapInArrow(read, "rid long, symbols binary" + "".join(f", {k} array<{t}>" for k, t in kinds.items())), "lm-texts")
    texts = own.select("rid", "size", "learn", "symbols")
    tree = learn_tree(texts, root, total)
    zipped = lambda *names: own.select("rid", F.posexplode(F.arrays_zip(*names)).alias("i", "x"))
    every = zipped("doc_id", "held_out", "size", "known", "base", "p").select((F.col("rid") + F.col("i")).alias("rid"), "x.*")
    rare = zipped("of", "word").select((F.col("rid") + F.col("x.of")).alias("rid"), "x.word")
    c, none = F.coalesce("c", F.lit(0)), lambda t: F.lit(None).cast(t)
    rare = rare.join(with_shares(vocab).select("word", "c", F.col("p").alias("wp")), "word", "left").select(
        "rid", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("int").alias("size"), (c > 0).cast("long").alias("known"), (F.log10(c + 1.0) - floor).alias("base"), F.col("wp").alias("p"))
    grown = tree_scores(texts, tree, total).select(
        "rid", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("int").alias("size"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.col("score").alias("p"))
    done = every.unionByName(rare).unionByName(grown).groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("size").cast("long").alias("n_tokens"),
        F.sum("known").cast("long").alias("n_known"), F.sum("base").alias("base_score"), F.sum("p").alias("score"))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = crc_mod(F.col("doc_id"), 7)
    return score(docs.select("doc_id", "text", F.coalesce(rest != 2, F.lit(False)).alias("learn"), F.coalesce(rest == 2, F.lit(False)).alias("held_out")))
