"""Toxicity by cumulative-link ordinal regression on sparse word features.

Severity grades run from 0 (clean) to 3. One weight vector is shared by all thresholds:
P(grade > k) = sigmoid(w . x - theta_k) with theta_0 < theta_1 < theta_2, and the expected severity is the sum of
these over k. Labels only say toxic or not; toxic rows of the sample are graded by how many marking words they
hold, a marking word being one whose odds in toxic rows exceed those in clean rows by a wide margin.

The fit uses a bounded sample: at most `SAMPLE` labelled rows of either kind, those with the smallest hash, of
distinct texts. Everything else, the scoring of whole texts, covers all rows in one map-only pass.

Labels that differ for equal texts, or for rows that repeat an id, count as toxic if one of them says so.

Defined cases: null and empty texts have severity 0. Very long texts are read whole. Repeated rows are judged each on its
own, and rows without an id like any other, though nothing is learned from them. Words of equal odds enter the
vocabulary in the order of their letters. Extra columns are not read, and `reject` returns them. Without labelled rows
of both kinds nothing is rejected. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import sliced, written

SAMPLE, VOCABULARY, GRADES, CUT = 4_000, 20_000, 4, 0.5
#: Words, as the fixed pattern that both Spark's expressions and Python's read alike.
LETTERS = r"[\p{L}\p{M}]+"
WORD = regex.compile(LETTERS)


@dataclass
class Model:
    weights: dict[str, float]
    thetas: list[float]

    def severity(self, x: float) -> float:
        return sum(1 / (1 + math.exp(min(700.0, t - x))) for t in self.thetas)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def thresholds(p: np.ndarray, size: int) -> np.ndarray:
    """Parameters are the weights, the first threshold, and the logs of the gaps to the next ones."""
    return np.concatenate([[p[size]], p[size] + np.cumsum(np.exp(np.clip(p[size + 1 :], -6, 6)))])


def loss(p: np.ndarray, rows: tuple, grades: np.ndarray, size: int, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of a cumulative link, with its penalty; and the gradient."""
    at, col, val = rows
    n, cuts, w, theta = len(grades), len(p) - size, p[:size], thresholds(p, size)
    x = np.bincount(at, val * w[col], n)
    above = np.column_stack([np.ones(n), *[sigmoid(x - t) for t in theta], np.zeros(n)])  # P(grade >= k)
    r = np.arange(n)
    hi, lo = above[r, grades], above[r, grades + 1]
    like = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
    gtheta = np.array([(dhi[grades == k + 1].sum() - dlo[grades == k].sum()) / n for k in range(cuts)])
    gaps = np.exp(np.clip(p[size + 1 :], -6, 6))
    g = np.concatenate([np.bincount(col, val * (dlo - dhi)[at] / n, size) + l2 * w, [gtheta.sum()], gaps * np.cumsum(gtheta[::-1])[::-1][1:]])
    return float(-np.log(like).mean() + l2 / 2 * (w @ w)), g


def sparse(rows: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return at, np.fromiter((k for r in rows for k in r), np.int64, len(at)), np.log1p(np.fromiter((v for r in rows for v in r.values()), np.float64, len(at)))


def fit_ordinal(rows: list[dict[int, int]], grades: np.ndarray, size: int, n_grades: int = GRADES, steps: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch Adam."""
    data, p = sparse(rows), np.zeros(size + n_grades - 1)
    p[size] = 1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        g = loss(p, data, grades, size, l2)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:size], thresholds(p, size)


def _counts(texts: list, index: dict[str, int]) -> list[dict[int, int]]:
    out = []
    for t in texts:
        c: dict[int, int] = {}
        for w in WORD.findall((t or "").lower()):
            if (k := index.get(w)) is not None:
                c[k] = c.get(k, 0) + 1
        out.append(c)
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Model | None:
    """None where there are no labelled rows of both kinds."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    order = [F.xxhash64("doc_id", F.lit(11)), "doc_id"]
    kinds = [known.where(f"toxic = {k}").select("doc_id", "toxic").orderBy(*order).limit(sample) for k in (0, 1)]
    chosen = written(kinds[0].union(kinds[1]), "toxicity-labels")  # at most twice `sample`
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = written(rows.withColumn("ws", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)))), "toxicity-sample")
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    n0, n1 = totals[0], totals[1]
    least = max(3, n1 // 200)
    odds = F.log(((F.col("n1") + 0.5) / (n1 + 1.0)) / ((F.col("n0") + 0.5) / (n0 + 1.0)))
    vocab = (
        rows.select("toxic", F.explode("ws").alias("w")).where("w <> ''").groupBy("w")
        .agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).where(F.col("n0") + F.col("n1") >= least)
        .withColumn("odds", odds).where(F.abs("odds") >= 0.7).orderBy(F.abs("odds").desc(), "w").limit(vocabulary).collect())
    if not vocab:
        return None
    index = {r.w: k for k, r in enumerate(vocab)}
    marks = {index[r.w] for r in vocab if r.odds >= 3 and r.n1 >= 4 * least}

    def run(batches):
        for b in sliced(batches, 0):
            found = _counts(b.column(0).to_pylist(), index)
            yield pa.RecordBatch.from_arrays([pa.array([list(c) for c in found], pa.list_(pa.int64())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64())), b.column(1)], ["k", "n", "toxic"])

    got = rows.select("text", "toxic").mapInArrow(run, "k array<long>, n array<long>, toxic int").collect()
    got.sort(key=lambda r: (r.toxic, r.k, r.n))
    counts = [dict(zip(r.k, r.n, strict=True)) for r in got]
    grade = lambda c: 1 + (sum(c.get(k, 0) for k in marks) > 2) + (sum(c.get(k, 0) for k in marks) > 5)
    grades = np.array([grade(c) if r.toxic else 0 for c, r in zip(counts, got, strict=True)])
    w, thetas = fit_ordinal(counts, grades, len(index))
    return Model({x: float(w[k]) for x, k in index.items() if abs(w[k]) > 1e-4}, thetas.tolist())


class Scorer:
    """Expected severity of texts; the vocabulary's words within each white-space piece are cached."""

    #: Entries of the cache, and the longest piece that it keeps; together they bound its bytes.
    LIMIT, LONG = 150_000, 64

    def __init__(self, model: Model):
        self.model, self.index, self.cache = model, {w: k for k, w in enumerate(model.weights)}, {}
        self.weights = list(model.weights.values())

    def __call__(self, text: str) -> float:
        counts: dict[int, int] = {}
        cache = self.cache
        for s in text.split():
            try:
                ks = cache[s]
            except KeyError:
                w = s.lower()
                ks = tuple(self.index[w] for w in ((w,) if w.isalpha() else WORD.findall(w)) if w in self.index)
                if len(s) <= self.LONG:
                    if len(cache) > self.LIMIT:
                        cache.clear()
                    cache[s] = ks
            for k in ks:
                counts[k] = counts.get(k, 0) + 1
        if not counts:
            return self.model.severity(0.0)
        return self.model.severity(sum(self.weights[k] * math.log1p(n) for k, n in counts.items()))


def score(docs: DataFrame, model: Model | None, cut: float = CUT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, severity (expected grade), grade (it rounded) and toxic (severity at or over the cut)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for b in sliced(batches, 1):
            s = [scorer(t) if scorer and t else 0.0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s, pa.float64()), pa.array([round(x) for x in s], pa.int32()), pa.array([x >= cut for x in s], pa.bool_())], ["doc_id", "severity", "grade", "toxic"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def reject(docs: DataFrame, model: Model | None, cut: float = CUT) -> DataFrame:
    """The documents whose severity is under the cut, with all their columns; rows are judged one by one, in place."""
    if model is None:
        return docs
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in sliced(batches, at):
            yield b.filter(pa.array([not t or scorer(t) < cut for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
