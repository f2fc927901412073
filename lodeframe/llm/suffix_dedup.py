"""Removing every byte that lies in a long string which also starts elsewhere: a distributed suffix merge.

Sorting all suffixes of a corpus would move each byte hundreds of times. So a sparse set of suffixes is sorted:
those that start at anchors. The anchor of a window of `length` bytes is the leftmost of its k-grams with the
smallest hash; it depends on the window alone, so equal windows have it at the same place. Then:

1. Anchors' hashes are counted; only anchors whose k-gram is an anchor elsewhere too are followed up.
2. Each task makes sorted runs of the suffixes at its anchors (the `length` bytes from there, and the bytes
   before them, both as far as a window reaches). Equal ones become one entry with a list of places. Runs are
   front-coded, cut by the k-gram they begin with, and exchanged.
3. Each receiving task merges its runs with a loser tree over known common prefixes: entries are compared by the
   prefix they share with the last one put out, and bytes only from there on. The merge thus yields the LCP array.
4. Within neighbours that share a k-gram, intervals of the LCP array are joined from the deepest up. Each holds its
   entries sorted by the bytes before the anchor, so an entry's longest common extension to the left within the
   interval is with a neighbour there. Right and left reach say which windows occur twice.
5. Windows go back to their documents as byte spans.

The result is exact: hashes only choose what is compared. Texts are shuffled once; that exchange is used again
for the last step.

Defined cases: null texts count as empty; texts under `length` bytes keep all; a row that is repeated is found
elsewhere (its copy) and so loses all its windows, as does one that repeats or lacks an id; very long texts are read in
chunks of `CHUNK` bytes; extra columns are not read, and `without_repeats` returns them; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodeframe.llm.common import sliced, written

LENGTH, GRAM = 200, 32
#: Bytes of a chunk of text whose anchors are found at once, and bytes of suffixes in a run.
CHUNK, RUN = 1 << 20, 16 << 20
#: Suffixes of a block, the unit in which a run is read, and bytes of suffixes that one merge is to have at most.
ENTRIES, PART = 512, 96 << 20
_PLACE = np.uint64((1 << 22) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each place on, by doubling."""
    with np.errstate(over="ignore"):
        base = 0x100000001B3
        power = lambda n: np.uint64(pow(base, n, 1 << 64))
        h, size, done, at = data.astype(np.uint64) + np.uint64(1), 1, None, 0
        want = gram
        while True:
            if want & 1:
                if done is None:
                    done, at = h, size
                else:
                    n = len(data) - at - size + 1
                    done = done[:n] * power(size) + h[at : at + n]
                    at += size
            want >>= 1
            if not want:
                return _mix(done)
            n = len(h) - size
            h = h[:n] * power(size) + h[size : size + n]
            size *= 2


def anchors(data: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of the windows that start where `valid` says."""
    h = gram_hashes(data, gram)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, size = length - gram + 1, 1
    low = key
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    n = len(key) - width + 1
    low = np.minimum(low[:n], low[width - size : width - size + n])
    at = (low[valid[:n]] & _PLACE).astype(np.int64)
    if len(at):
        at = at[np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))]  # windows move on, and so do their anchors
    return at, h[at].view(np.int64)


def _chunks(texts: list[bytes | None], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, part): texts of CHUNK bytes together, longer ones cut with an overlap of length - 1."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if t is None or len(t) < length:
            continue
        for a in range(0, max(1, len(t) - length + 1), CHUNK):
            part = t[a : a + CHUNK + length - 1]
            held.append((i, a, part))
            size += len(part)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchor_rows(texts: list[bytes | None], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of all anchors of some texts."""
    out = []
    for parts in _chunks(texts, length):
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        sizes = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(parts)), sizes)
        at, h = anchors(data, np.arange(len(data)) + length <= ends[owner], length, gram)
        own = owner[at]
        out.append((np.array([i for i, _, _ in parts])[own], at - (ends - sizes)[own] + np.array([a for _, a, _ in parts])[own], h))
    if not out:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need not be looked at."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_coded(entries: dict[tuple[bytes, bytes], list]) -> bytes:
    """A sorted run, in blocks: each suffix as (bytes shared with the one before, the rest, the bytes to the left, places)."""
    blocks, out, last = [], [], b""
    for fwd, bwd in sorted(entries):
        n = shared(last, fwd)
        out.append((n, fwd[n:], bwd, entries[fwd, bwd]))
        last = fwd
        if len(out) == ENTRIES:
            blocks.append(zlib.compress(pickle.dumps(out, 5), 1))
            out = []
    if out:
        blocks.append(zlib.compress(pickle.dumps(out, 5), 1))
    return pickle.dumps(blocks, 5)


def entries_of(run: bytes) -> Iterator[tuple]:
    """The entries of a run; one block is unpacked at a time."""
    for block in pickle.loads(run):
        yield from pickle.loads(zlib.decompress(block))


def merged(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes, list]]:
    """(LCP with the suffix before, suffix, bytes to the left, places) of all runs in order, by an LCP loser tree.

    All heads in play know the prefix that they share with the last suffix put out. Of two, the one that shares
    more comes first, and what they share is the lesser of both; only when they share equally are bytes read,
    from there on. A run's next head shares with it what the front coding says.
    """
    lists = [entries_of(r) for r in runs]
    k = 1
    while k < len(lists):
        k *= 2
    text: list[bytes | None] = [None] * k
    known, rest = [0] * k, [None] * k

    def advance(i: int) -> None:
        e = next(lists[i], None) if i < len(lists) else None
        if e is None:
            text[i] = None
        else:
            n, tail, bwd, where = e
            text[i] = (text[i] or b"")[:n] + tail
            known[i], rest[i] = n, (bwd, where)

    def duel(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes what it shares with the winner."""
        a, b = text[i], text[j]
        if b is None:
            return i, j
        if a is None:
            return j, i
        x, y = known[i], known[j]
        if x != y:
            return (i, j) if x > y else (j, i)
        n = shared(a, b, x)
        first = len(a) == n or (len(b) > n and a[n] < b[n])
        if first:
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    for i in range(len(lists)):
        advance(i)
    loser = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, loser[node] = duel(build(2 * node), build(2 * node + 1))
        return w

    win = build(1)
    while text[win] is not None:
        yield known[win], text[win], *rest[win]
        advance(win)
        node = (win + k) // 2
        while node:
            win, loser[node] = duel(win, loser[node])
            node //= 2


def doubled(group: list[tuple[int, bytes, bytes, list]], length: int) -> list[list[tuple[int, int]]]:
    """For each entry of a group (neighbours that share a k-gram) the spans, relative to its anchor, found twice."""
    spans: list[list[tuple[int, int]]] = [[] for _ in group]

    def mark(i: int, depth: int, left: int) -> None:
        if depth + left >= length:
            spans[i].append((-left, depth))  # from the earliest window's start to the latest one's end

    for i, (_, fwd, bwd, where) in enumerate(group):
        if len(where) > 1:
            mark(i, len(fwd), len(bwd))
    # Intervals of the LCP array, the deepest first: each is a list sorted by the bytes to the left.
    of: list[int] = list(range(len(group)))
    sets: dict[int, list[tuple[bytes, int]]] = {i: [(e[2], i)] for i, e in enumerate(group)}

    def root(i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for i in sorted(range(1, len(group)), key=lambda i: -group[i][0]):
        depth, a, b = group[i][0], root(i - 1), root(i)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        big = sets[a]
        for item in sets.pop(b):
            at = bisect_left(big, item)
            for other in big[max(0, at - 1) : at + 1]:
                n = shared(item[0], other[0])
                mark(item[1], depth, n)
                mark(other[1], depth, n)
            big.insert(at, item)
        of[b] = a
    return spans


def repeat_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (rid long, text binary, more): adds `spans`, an array of [start, end) that lie in doubled windows.

    rid stands for a row's content: rows that share it must be equal.
    """
    spark = docs.sparkSession
    more = docs.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            rid = b.column(0).to_numpy(zero_copy_only=False)
            row, place, h = anchor_rows(b.column(1).to_pylist(), length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(rid[row].astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(h)], ["rid", "place", "h"])

    found = docs.select("rid", "text").mapInArrow(find, "rid long, place int, h long")
    # Written, so that both sides of the join are plain exchanges, whose large partitions AQE can split.
    often = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "suffix-grams")
    # As many merges as the followed suffixes need, at least those that the session asks for.
    followed = often.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-followed * 2 * length // PART))
    places = found.join(often.select("h"), "h", "left_semi").groupBy("rid").agg(F.collect_set("place").alias("places"))
    at_text, at_places = more.index("text"), len(more)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, dict] = {}
        size = 0

        def out() -> pa.RecordBatch:
            made = [(p, front_coded(e)) for p, e in runs.items()]
            runs.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.int32()), pa.array([r for _, r in made], pa.binary())], ["part", "run"])

        for b in sliced(batches, at_text):
            for rid, text, at in zip(b.column(0).to_pylist(), b.column(at_text).to_pylist(), b.column(at_places).to_pylist(), strict=True):
                for p in at:
                    fwd, bwd = text[p : p + length], text[max(0, p - length + gram) : p][::-1]
                    entries = runs.setdefault(zlib.crc32(fwd[:gram]) % parts, {})
                    if (fwd, bwd) not in entries:
                        entries[fwd, bwd] = []
                        size += len(fwd) + len(bwd) + 200
                    entries[fwd, bwd].append((rid, p))
                    size += 100
                if size >= RUN:
                    yield out()
                    size = 0
        yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [r for b in batches for r in b.column(1).to_pylist()]
        rows: list[tuple[int, int, int]] = []

        def take() -> pa.RecordBatch:
            a = np.array(rows, dtype=np.int64).reshape(-1, 3)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[:, k]) for k in range(3)], ["rid", "a", "b"])

        def close(group: list) -> None:
            if len(group) > 1 or len(group[0][3]) > 1:
                for spans, e in zip(doubled(group, length), group, strict=True):
                    for a, b in _union(spans):
                        rows.extend((rid, p + a, p + b) for rid, p in e[3])

        group: list = []
        for e in merged(runs) if runs else ():
            if group and e[0] < gram:
                close(group)
                group = []
                if len(rows) > 50_000:
                    yield take()
            group.append(e)
        if group:
            close(group)
        yield take()

    # The same exchange of texts serves here and below: both joins hash by rid and read the same columns.
    runs = docs.join(places.hint("shuffle_hash"), "rid").select(*more, "places").mapInArrow(sort, "part int, run binary")
    marks = runs.repartitionById(parts, F.col("part")).mapInArrow(merge, "rid long, a long, b long")
    spans = marks.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return docs.join(spans.hint("shuffle_hash"), "rid", "left").select(*more, "spans")


def _union(spans: list) -> list[tuple[int, int]]:
    """Spans joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _rid(docs: DataFrame, doc_id: str) -> Column:
    """The id where it is a whole number that no two rows share, else a hash of the whole row."""
    if doc_id in docs.columns and docs.schema[doc_id].dataType.simpleString() in ("int", "bigint"):
        own = docs.select(F.col(doc_id).alias("id"))
        if own.groupBy("id").count().where("id IS NULL OR count > 1").isEmpty():
            # Not null for the optimiser too: then both joins below read one and the same exchange.
            return F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long"))
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        for b in sliced(batches, 2):
            rows = []
            for t, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                s = _union([(x["a"], x["b"]) for x in spans or ()])
                rows.append((len(t), sum(y - x for x, y in s), len(s), hashlib.sha256(cut(t, s)).hexdigest(), [list(x) for x in s]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(1), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.list_(pa.int64())))], names)

    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own = docs.select(_rid(docs, "doc_id").alias("rid"), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return repeat_spans(own, length, gram).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, same columns, with doubled bytes gone from their texts; halves of a character that was cut go too."""
    names = [c for c in docs.columns if c != text]
    own = docs.select(_rid(docs, doc_id).alias("rid"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"), F.col(text).isNull().alias("_null"), F.struct(*names).alias("_more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            out = []
            for t, null, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                out.append(None if null else cut(t, _union([(x["a"], x["b"]) for x in spans or ()])).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(3)], ["text", "_more"])

    more = own.schema["_more"].dataType
    done = repeat_spans(own, length, gram).mapInArrow(run, StructType([StructField("text", StringType()), StructField("_more", more)]))
    return done.select(*[F.col("text").alias(text) if c == text else F.col(f"_more.`{c}`").alias(c) for c in docs.columns])


def op1(spark, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
