"""Packing documents into fixed windows of tokens by minimum bin slack.

Tokens are counted and cut where the scan delivers the documents, so nothing is shuffled. Each task keeps a
pool of documents. Full windows are cut from long documents first; the rest lengths form a multiset, and a
bitset subset-sum dynamic program picks the multiset that fills a window closest to its capacity. Counts of
each length are found by walking the stored bitsets backwards. A window that no subset fills exactly is topped
up by cutting one document. What is left at a task's end is cut at powers of two, which need no padding.

Defined cases: a null or empty text has only the end token. Repeated rows are packed each on its own, and rows with a
null id with that. A very long text is read whole and fills windows of its own. Bytes that are not UTF-8 count as
replacement characters. Extra columns are not read. An empty table gives no rows. A retried task gets the same rows in
the same order and so packs alike.
"""

from __future__ import annotations

import zlib
from array import array
from codecs import charmap_decode
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import sliced

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

#: Pools hold so many tokens, which bounds a task's memory.
POOL_TOKENS = 2_000_000


class Cache(dict):
    """Pieces and their ids, found by `ids` where they are not there; bounded by bytes, and pieces over `LONG` bytes are
    kept until `long` is emptied."""

    #: Bytes of the cache and of the one before it, each.
    LIMIT, LONG = 30 << 20, 64
    #: What an entry takes besides its bytes: two objects and a place in the dictionary.
    ENTRY = 180

    def __init__(self, ids: Callable[[bytes], bytes]):
        super().__init__()
        self.ids, self.held = ids, 0
        self.old: dict[bytes, bytes] = {}  # the cache before, of which what is used again is taken over
        self.long: dict[bytes, bytes] = {}

    def __missing__(self, s: bytes) -> bytes:
        if len(s) > self.LONG:
            if (found := self.long.get(s)) is None:
                found = self.long[s] = self.ids(s)
            return found
        if (found := self.old.get(s)) is None:
            found = self.ids(s)
        if self.held > self.LIMIT:
            self.old, self.held = dict(self), 0
            super().clear()
        self[s] = found
        self.held += len(s) + len(found) + self.ENTRY
        return found

    def clear(self) -> None:
        super().clear()
        self.old, self.long, self.held = {}, {}, 0


class WordTokenizer:
    """Ids of texts as little-endian 32-bit bytes, with a bounded cache of words between white space.

    The vocabulary splits texts at white space before anything else and drops it, so a text's ids are those of
    its white-space pieces in order. Within a piece, parts without upper-case or special letters go to the
    model itself; all others go through the tokenizer's whole chain. A part is held as the piece that it would be on its
    own. Long pieces (text without blanks, encoded data) are kept for one text only.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cache = Cache(self.piece)
        # Parts of a word as the vocabulary's own file splits them; and the bytes' printable forms.
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.shown = "".join(chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256))
        self.tokenize = self.tok.model.tokenize
        # The short way is for ASCII and Latin letters whose composed lower case is one code point.
        self.easy = regex.compile(r"[!-~¡-¬®-įı-ſ]*").fullmatch

    def piece(self, s: bytes) -> bytes:
        word = s.rstrip(b".,;:!?")
        if word.isalpha():  # ASCII letters alone
            low = word.lower()
            if low == s:
                return self.model_ids(s.decode())
            return self.cache[low] if len(word) == len(s) else self.cache[low] + self.cache[s[len(word) :]]
        u = s.decode("utf-8", "replace")
        if "<|" in u or not (u.isascii() and u.isprintable() or self.easy(u)):
            return array("I", self.tok.encode(u, add_special_tokens=False).ids).tobytes()
        low = u.lower()
        parts = [low] if low.isalpha() else self.parts(low)
        if len(parts) > 1:
            return b"".join([self.cache[p.encode()] for p in parts])
        return self.model_ids(u) if parts[0] == u else self.cache[parts[0].encode()]

    def model_ids(self, p: str) -> bytes:
        shown = p if p.isascii() else charmap_decode(p.encode(), "strict", self.shown)[0]
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def __call__(self, text: bytes) -> bytes:
        # Bytes split at ASCII white space alone; other kinds stay inside pieces.
        ids = b"".join(map(self.cache.__getitem__, text.split()))
        if self.cache.long:
            self.cache.long = {}
        return ids

    def clear(self) -> None:
        self.cache.clear()


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset within `counts` (length -> how many there are) whose sum is as close below capacity as can be.

    Bounded subset sum over bitsets: copies of one length are taken in parcels of 1, 2, 4, ... The bitset before
    each parcel is stored, and the best sum is traced back through them to counts per length.
    """
    mask, reach, parcels = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, parcel = min(counts[length], capacity // length), 1
        while left > 0:
            k = min(parcel, left)
            parcels.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, parcel = left - k, parcel * 2
        if reach >> capacity & 1:
            break
    best, taken = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(parcels):
        if not before >> best & 1:
            taken[length] += k
            best -= length * k
    return taken


class Packer:
    """Packs pieces of one task; sequence ids count up from `first`."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.sequence, self.rows, self.last = capacity, first, [], 0
        self.rest: dict[int, list] = defaultdict(list)

    def put(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, data, start, length, total in pieces:
            self.rows.append((doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), total, self.sequence, offset))
            offset += length
        self.sequence += 1

    def add(self, doc: int, data: bytes) -> None:
        total = len(data) // 4
        full = total // self.capacity * self.capacity
        for start in range(0, full, self.capacity):
            self.put([(doc, data, start, self.capacity, total)])
        if total > full:
            self.rest[total - full].append((doc, data, full, total - full, total))

    def pack(self, end: bool) -> None:
        """Fills windows while the pool holds enough for one; at the end also the remainder."""
        held = sum(k * len(v) for k, v in self.rest.items())
        while held >= self.capacity:
            taken, window = fill({k: len(v) for k, v in self.rest.items()}, self.capacity), []
            for length, k in taken.items():
                window += [self.rest[length].pop() for _ in range(k)]
                if not self.rest[length]:
                    del self.rest[length]
            short = self.capacity - sum(x[3] for x in window)
            while short:  # no subset fills it: cut the shortest document that is long enough, or take whole ones
                length = min((k for k in self.rest if k >= short), default=max(self.rest))
                doc, data, start, n, total = self.rest[length].pop()
                if not self.rest[length]:
                    del self.rest[length]
                cut = min(short, n)
                window.append((doc, data, start, cut, total))
                if n > cut:
                    self.rest[n - cut].append((doc, data, start + cut, n - cut, total))
                short -= cut
            self.put(window)
            held -= self.capacity
        if end and held:
            left = [x for k in sorted(self.rest, reverse=True) for x in self.rest[k]]
            self.rest.clear()
            for bit in reversed(range(held.bit_length())):
                if held >> bit & 1:
                    window, room = [], 1 << bit
                    while room:
                        doc, data, start, n, total = left.pop()
                        cut = min(room, n)
                        window.append((doc, data, start, cut, total))
                        if n > cut:
                            left.append((doc, data, start + cut, n - cut, total))
                        room -= cut
                    self.put(window)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, schema=_ARROW)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: which tokens of which document stand where in which sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(tokenizer_path), array("I", [end_id]).tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        held = 0
        for batch in sliced(batches, 1):
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = tok(t or b"") + end
                packer.add(doc, data)
                held += len(data) // 4
                if held >= POOL_TOKENS:
                    packer.pack(False)
                    held = 0
                    yield packer.take()
        packer.pack(True)
        tok.clear()  # workers are used again, by other operators too
        yield packer.take()

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(run, SCHEMA)


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
