"""Language identification by hierarchical discrimination: family first, then the language within it.

Features are relative frequencies of hashed byte 2- and 3-grams of the lower-cased text, everything but letters
taken as one blank. Linear support vector machines (hinge loss, trained by dual coordinate descent) tell each family
from all others; within a family they are one-versus-one, and votes decide, then margins. Languages outside the
known families form families of `GROUP`, in the order of their names, so machines grow with the number of languages
and not with its square.

The machines are fitted on a bounded sample of labelled rows: of each language those whose id hashes lowest,
`PER_LANGUAGE` of them, or fewer where there would be more than `SAMPLE` in all, but `FEWEST` at least. Prediction
covers every whole text in one map-only pass. Only text and lang are learned from; a prediction looks at nothing but
the text.

Defined cases: null texts and texts without a letter are `und` with score 0. Very long texts are read whole, in parts of
`PART` bytes. Repeated rows are judged each on its own. Equal votes go by margins, equal margins to the first name. A
single learned language is predicted with score 1; without any, everything is `und`. A null id neither learns nor counts
as held out. Extra columns are not read unless named in `keep`. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.common import crc_mod, sliced

PER_LANGUAGE, SAMPLE, FEWEST, BITS, SCALE = 400, 4_000, 20, 15, 40.0
GROUP, PART = 8, 4 << 20
#: Languages of the larger families; any other joins a group of them.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "turkic": "tr az uz kk ky",
    "indic": "hi bn mr ur ne gu pa",
    "finnic": "fi et",
}
FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs.split()}
#: Lower-cases A-Z and turns every other ASCII byte but a-z into a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2- and 3-grams from each place on."""
    x = data.astype(np.uint32)
    two = x[:-1] << np.uint32(8) | x[1:]
    three = two[:-1] << np.uint32(8) | x[2:]
    with np.errstate(over="ignore"):
        cut = np.uint32(32 - BITS)
        return (two * np.uint32(2654435761)) >> cut, (three * np.uint32(2246822519) + np.uint32(374761393)) >> cut


def counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" " + text.translate(_TABLE) + b"  ", np.uint8)
    n = np.bincount(np.concatenate(grams(data)), minlength=1 << BITS)
    k = np.flatnonzero(n)
    return k, n[k]


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Weights, the last one being the bias, of a hinge-loss machine by dual coordinate descent."""
    w, alpha = np.zeros((1 << BITS) + 1), np.zeros(len(rows))
    norms = np.array([v @ v + 1.0 for _, v in rows])
    rng = np.random.RandomState(1)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            k, v = rows[i]
            g = y[i] * (w[k] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), c)
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[k] += d * v
                w[-1] += d
                alpha[i] = new
    return w


def families_of(langs: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    others = sorted(x for x in langs if x not in FAMILY)
    for x in sorted(langs):
        out.setdefault(FAMILY[x] if x in FAMILY else f"other {others.index(x) // GROUP}", []).append(x)
    return dict(sorted(out.items()))


@dataclass
class Model:
    """table: grams x machines; first one for each family if there are several, then those of `pairs` (a, b)."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    table: np.ndarray
    bias: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        parts = [b" " + t.translate(_TABLE) + b"  " for t in texts]
        sizes = np.array([len(p) for p in parts])
        out, starts = np.zeros((len(texts), self.table.shape[1])), np.cumsum(sizes) - sizes
        step = max(1024, PART // (4 * self.table.shape[1]))  # places whose weights are held at once
        for at, codes in zip((0, 1), grams(np.frombuffer(b"".join(parts), np.uint8)), strict=True):
            for k in range(1, at + 2):  # grams that reach into the next text weigh nothing
                codes[(starts[1:] - k)] = 1 << BITS
            for i in range(0, len(codes), step):
                own = codes[i : i + step]
                a, b = np.searchsorted(starts, [i, i + len(own) - 1], "right") - 1
                edges = np.maximum(starts[a : b + 1], i) - i
                out[a : b + 1] += np.add.reduceat(self.table[own], edges, axis=0, dtype=np.float64)
        return out / (2 * sizes - 3)[:, None] * SCALE + self.bias

    def choose(self, langs: list[str], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner among the languages of a family by votes, then by margins; and its least margin."""
        votes, least = np.zeros((len(m), len(langs))), np.full((len(m), len(langs)), np.inf)
        for k, (a, b) in enumerate(self.pairs, self.table.shape[1] - len(self.pairs)):
            if a in langs:
                for x, s in ((langs.index(a), m[:, k]), (langs.index(b), -m[:, k])):
                    votes[:, x] += (s > 0) + 1e-3 * np.tanh(s)
                    least[:, x] = np.minimum(least[:, x], s)
        best = votes.argmax(axis=1)
        return best, least[np.arange(len(m)), best]

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        if not texts:
            return []
        m, several = self.margins(texts), len(self.families) > 1
        family = m[:, : len(self.families)].argmax(axis=1) if several else np.zeros(len(m), int)
        sure = m[np.arange(len(m)), family] if several else np.full(len(m), np.inf)
        out = [("", 0.0)] * len(texts)
        for k, langs in enumerate(self.families.values()):
            rows = np.flatnonzero(family == k)
            best, margin = self.choose(langs, m[rows])
            for r, b, s in zip(rows.tolist(), best.tolist(), np.minimum(margin, sure[rows]).tolist(), strict=True):
                out[r] = (langs[b], float(1 / (1 + np.exp(-np.clip(2 * s, -700, 700)))))
        return out


def _letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, learn: Column) -> Model | None:
    """docs (doc_id, text, lang); learn: which rows may be learned from."""
    known = docs.where(learn & F.col("lang").isNotNull() & _letters(F.col("text")))
    sizes = known.groupBy("lang").count()
    n_langs = sizes.count()
    if not n_langs:
        return None
    quota = min(PER_LANGUAGE, max(FEWEST, SAMPLE // n_langs))
    # Three times as many as are wanted, by a bound on the hash; of these the lowest.
    place = F.xxhash64("doc_id", F.lit(3))
    drawn = F.pmod(place, F.lit(1 << 30)) < F.least(F.lit(1.0), 3.0 * quota / F.col("count")) * float(1 << 30)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(place, F.lit(1 << 30)), place, "doc_id", "text"))
    rows = known.join(F.broadcast(sizes) if n_langs <= 100_000 else sizes, "lang").where(drawn)
    rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= quota).select("lang", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            found = [counts(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([k.astype(np.uint16).tobytes() for k, _ in found], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in found], pa.binary())], ["lang", "k", "n"])

    got = sorted(rows.mapInArrow(run, "lang string, k binary, n binary").collect())
    data = [(np.frombuffer(r.k, np.uint16).astype(np.int64), np.frombuffer(r.n, np.uint32).astype(np.float64)) for r in got]
    data = [(k, n / n.sum() * SCALE) for k, n in data]
    families = families_of(sorted({r.lang for r in got}))
    family = {x: f for f, langs in families.items() for x in langs}
    pairs = [x for langs in families.values() for x in combinations(langs, 2)]
    every = np.array([r.lang for r in got])
    tasks = [(np.ones(len(got), bool), np.array([family[x] for x in every]) == f) for f in families] if len(families) > 1 else []
    tasks += [(np.isin(every, (a, b)), every == a) for a, b in pairs]
    table, bias = np.zeros(((1 << BITS) + 1, max(1, len(tasks))), np.float32), np.zeros(max(1, len(tasks)))
    for t, (among, positive) in enumerate(tasks):
        w = fit_svm([data[i] for i in np.flatnonzero(among)], np.where(positive[among], 1.0, -1.0))
        table[:-1, t], bias[t] = w[:-1], w[-1]
    return Model(families, pairs, table, bias)


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, and what is named in `keep`."""
    own = docs.select("doc_id", F.when(_letters(F.col("text")), F.col("text").cast("binary")).alias("text"), *keep)
    shared = own.sparkSession.sparkContext.broadcast(model)  # of a size fixed by BITS for each learned language
    types = {"lang_pred": pa.string(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches, 1):
            texts = b.column(1).to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None] if m else []
            out = [("und", 0.0)] * len(texts)
            for i, x in zip(some, m.predict([texts[i] for i in some]) if m else [], strict=True):
                out[i] = x
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate(types.values())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *[b.column(k + 2) for k in range(len(keep))]], ["doc_id", *types, *keep])

    kept = "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double{kept}")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rest = crc_mod(F.col("doc_id"), 3)
    found = identify(docs.withColumn("held_out", F.coalesce(rest == 1, F.lit(False))), train(docs, F.coalesce(rest != 1, F.lit(False))), ("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score")
