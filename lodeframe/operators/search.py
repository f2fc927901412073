"""Full-text search: a tokeniser, postings, a query language compiled to one predicate, and grouped aggregation.

Query language: words (all must match), a|b, "a phrase", pre* *fix *mid*, word%n (at most n edits), -not, ~optional,
( ), @field:word, @field:(query), @tag:{a|b}, @number:[low high] with ( for open ends, @place:[lon lat radius unit],
[KNN k @vector $name], [VECTOR_RANGE distance @vector $name].
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.operators import geo, vectors

#: Words that are not indexed.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


#: A node [KNN k @field $name] or [VECTOR_RANGE distance @field $name].
VECTOR_NODE = re.compile(r"\[\s*(KNN|VECTOR_RANGE)\s+([0-9.]+)\s+@(\w+)\s+\$(\w+)\s*\]", re.I)
DISTANCES = {"l2": vectors.l2, "cosine": vectors.cosine_distance, "ip": lambda a, b: -vectors.dot(a, b)}


def tokens(text: Column) -> Column:
    """Words in order: lower case, split at what is neither letter nor digit, stop words left out."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(term, doc, tf): the index as a table; write it bucketed by term to look terms up without a shuffle."""
    words = docs.select(F.col(doc).alias("doc"), F.explode(tokens(F.col(text))).alias("term"))
    return words.groupBy("term", "doc").agg(F.count("*").alias("tf"))


def ranked_or(docs: DataFrame, doc: str, text: str, query: str, offset: int = 0, count: int | None = 10) -> DataFrame:
    """(doc, score): documents with any of the query's words, by the sum of their frequencies."""
    terms = [w for w in re.split(r"[\W_]+", query.lower()) if w and w not in STOP_WORDS]
    if not terms:
        out = docs.select(F.col(doc).alias("doc"), F.lit(1.0).alias("score"))
    else:
        hits = F.size(F.filter(tokens(F.col(text)), lambda w: w.isin(terms)))
        out = docs.select(F.col(doc).alias("doc"), hits.cast("double").alias("score")).where("score > 0")
    if count is None:  # all of them, in no order
        return out
    out = out.orderBy(F.col("score").desc(), "doc")
    return (out.offset(offset) if offset else out).limit(count)


_TOKEN = re.compile(r"""\s*(?:(?P<field>@\w+):|(?P<phrase>"[^"]*")|(?P<tags>\{[^}]*\})|(?P<range>\[[^\]]*\])|(?P<op>[()|~])|(?P<not>-)|(?P<word>[^\s()|"{}\[\]@~]+))""")


class _Query:
    """Compiles to predicates over text (arrays of tokens), tag, number and point columns."""

    def __init__(self, text: str, fields: dict[str, str]):
        self.fields, self.at, self.tokens, i = fields, 0, [], 0
        self.texts = [c for c, kind in fields.items() if kind == "text"]
        text = text.strip()
        while i < len(text):
            m = _TOKEN.match(text, i)
            if not m:
                raise ValueError(f"query: cannot read {text[i:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            i = m.end()

    def next(self) -> tuple[str, str] | tuple[None, None]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def either(self, within: str | None = None) -> Column:
        out = self.all(within)
        while self.next() == ("op", "|"):
            self.at += 1
            out = out | self.all(within)
        return out

    def all(self, within: str | None) -> Column:
        out, any_part = F.lit(True), False
        while self.next()[0] is not None and self.next() not in (("op", "|"), ("op", ")")):
            out, any_part = (out & self.one(within) if any_part else self.one(within)), True
        return out

    def one(self, within: str | None) -> Column:
        kind, t = self.next()
        self.at += 1
        if kind == "not":
            return ~self.one(within)
        if kind == "op" and t == "~":
            self.one(within)
            return F.lit(True)
        if kind == "op" and t == "(":
            inner = self.either(within)
            if self.next() != ("op", ")"):
                raise ValueError("query: ) expected")
            self.at += 1
            return inner
        if kind == "field":
            return self.field(next((c for c in self.fields if c.lower() == t[1:].lower()), t[1:]))
        if kind == "phrase":
            words = [w for w in re.split(r"[\W_]+", t.lower()) if w and w not in STOP_WORDS]
            return self.over(within, lambda a: F.contains(F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" ")), F.lit(f" {' '.join(words)} ")))
        if kind == "word":
            return self.word(t.lower(), within)
        if kind == "range" and (m := VECTOR_NODE.fullmatch(t)):
            return self.vector(t, m)
        raise ValueError(f"query: {t!r} is out of place")

    def over(self, within: str | None, test) -> Column:
        out = F.lit(False)
        for c in [within] if within else self.texts:
            out = out | F.coalesce(test(F.col(c)), F.lit(False))
        return out

    def word(self, w: str, within: str | None) -> Column:
        if w == "*":
            return F.lit(True)
        if m := re.fullmatch(r"(.+)%(\d+)", w):
            return self.over(within, lambda a: F.exists(a, lambda x: F.levenshtein(x, F.lit(m[1])) <= int(m[2])))
        core = w.strip("*")
        if w.startswith("*") and w.endswith("*"):
            return self.over(within, lambda a: F.exists(a, lambda x: F.contains(x, F.lit(core))))
        if w.endswith("*"):
            return self.over(within, lambda a: F.exists(a, lambda x: F.startswith(x, F.lit(core))))
        if w.startswith("*"):
            return self.over(within, lambda a: F.exists(a, lambda x: F.endswith(x, F.lit(core))))
        return self.over(within, lambda a: F.array_contains(a, w))

    def vector(self, t: str, m: re.Match) -> Column:
        """Within a distance of a query's vector; or among its nearest, which `search` marks beforehand."""
        if m[1].upper() == "KNN":
            return F.col(f"_knn_{self.nearest.index(t)}")
        return self.distance(m) <= float(m[2])

    def distance(self, m: re.Match) -> Column:
        kind = self.fields.get(m[3], "")
        if not kind.startswith("vector") or m[4] not in self.params:
            raise ValueError(f"query: there is no vector field {m[3]}, or no parameter {m[4]}")
        return DISTANCES[kind.partition(" ")[2] or "l2"](F.col(m[3]), vectors.constant(self.params[m[4]]))

    @property
    def nearest(self) -> list[str]:
        return [t for k, t in self.tokens if k == "range" and (m := VECTOR_NODE.fullmatch(t)) and m[1].upper() == "KNN"]

    def field(self, name: str) -> Column:
        if name not in self.fields:
            raise ValueError(f"query: there is no field {name}")
        kind, t = self.next()
        if kind == "tags":
            self.at += 1
            return F.lower(F.col(name)).isin([x.strip().lower() for x in t[1:-1].split("|")])
        if kind == "range":
            self.at += 1
            parts = t[1:-1].split()
            if len(parts) == 4:
                lon, lat, r = map(float, parts[:3])
                return geo.distance(F.col(f"{name}.lon"), F.col(f"{name}.lat"), F.lit(lon), F.lit(lat), parts[3].lower()) <= r
            (lo, hi), c = parts, F.col(name)
            low, high = float(lo.strip("()")), float(hi.strip("()"))
            return ((c > low) if lo[0] == "(" else (c >= low)) & ((c < high) if hi[0] == "(" or hi[-1] == ")" else (c <= high))
        return self.one(name)


def search(docs: DataFrame, query: str, fields: dict[str, str], params: dict[str, list[float]] | None = None, doc: str = "doc_id") -> DataFrame:
    """Rows that match. fields: column -> text, tag, numeric, geo or vector; a geo column is a struct of lon and lat, a
    vector one may name its distance: "vector cosine", "vector ip", else l2. params: the vectors that a query names."""
    named = docs
    for c, kind in fields.items():
        if kind == "text":
            named = named.withColumn(f"_t_{c}", tokens(F.col(c)))
    q = _Query(query, {f"_t_{c}" if kind == "text" else c: kind for c, kind in fields.items()})
    q.params = params or {}
    alias = {c.lower(): f"_t_{c}" for c, kind in fields.items() if kind == "text"}
    q.tokens = [(k, f"@{alias[t[1:].lower()]}" if k == "field" and t[1:].lower() in alias else t) for k, t in q.tokens]
    for i, t in enumerate(q.nearest):
        m = VECTOR_NODE.fullmatch(t)
        near = docs.select(F.col(doc), q.distance(m).alias("_d")).where("_d IS NOT NULL").orderBy("_d", doc).limit(int(m[2]))
        near = near.select(F.col(doc), F.lit(True).alias("_near"))
        # A query's own k rows.
        named = named.join(F.broadcast(near), doc, "left").withColumn(f"_knn_{i}", F.coalesce("_near", F.lit(False))).drop("_near")
    where = q.either()
    if q.at != len(q.tokens):
        raise ValueError(f"query: {q.tokens[q.at][1]!r} is left over")
    return named.where(where).select(*docs.columns)


def page(hits: DataFrame, keep: list[str], sort: tuple[str, bool] | None = None, offset: int = 0, count: int = 10, keys: tuple[str, list] | None = None,
         between: tuple[str, float, float] | None = None) -> DataFrame:
    """Options of a search: named columns of a page of the hits in an order (column, descending; ties by the kept
    columns), among given keys (column, values) and a numeric range, and how many hits there are in all."""
    if keys:
        hits = hits.where(F.col(keys[0]).isin(keys[1]))
    if between:
        hits = hits.where(F.col(between[0]).between(between[1], between[2]))
    total = hits.agg(F.count("*").alias("total"))
    order = ([F.col(sort[0]).desc() if sort[1] else F.col(sort[0])] if sort else []) + keep
    rows = hits.orderBy(*order)
    rows = (rows.offset(offset) if offset else rows).limit(count).select(*keep)
    return rows.join(F.broadcast(total))  # one row


def find(index: DataFrame, terms: list[str], every: bool = True) -> DataFrame:
    """(doc, score): documents with all (or any) of the terms, from postings (term, doc, tf) alone, by the sum of their
    frequencies. On a table that is bucketed by term only the buckets of the terms are read."""
    terms = sorted({t.lower() for t in terms})
    hits = index.where(F.col("term").isin(terms)).groupBy("doc").agg(F.sum("tf").cast("double").alias("score"), F.count("*").alias("_n"))
    return (hits.where(F.col("_n") == len(terms)) if every else hits).drop("_n")


REDUCERS = {
    "count": lambda c: F.count("*"), "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
}


def aggregate(rows: DataFrame, by: list[str], reducers: list[tuple[str, str | None, str]], apply: dict[str, str] | None = None,
              where: str | None = None, sort: list[tuple[str, bool]] | None = None, offset: int = 0, count: int = 100) -> DataFrame:
    """Groups by any number of fields (null becomes "(nil)"), any number of reducers (kind, column, name), then
    expressions, a filter, an order (column, descending; by default the groups) and a limit."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("(nil)")).alias(c) for c in by]
    out = rows.groupBy(*keys).agg(*[REDUCERS[k](c).alias(n) for k, c, n in reducers])
    for name, e in (apply or {}).items():
        out = out.withColumn(name, F.expr(e))
    if where:
        out = out.where(where)
    out = out.orderBy(*[F.col(c).desc() if d else F.col(c) for c, d in (sort or [])], *by)
    return (out.offset(offset) if offset else out).limit(count)


def tag_values(docs: DataFrame, column: str, separator: str = ",") -> DataFrame:
    return docs.select(F.explode(F.split(F.lower(F.col(column)), re.escape(separator))).alias("_v")).select(F.trim("_v").alias("value")).where("value <> ''").distinct()


def spellcheck(vocabulary: DataFrame, word: str, distance: int = 1) -> DataFrame:
    """vocabulary (term, n): terms within a number of edits, the most frequent first."""
    close = vocabulary.where(F.abs(F.length("term") - len(word)) <= distance)
    return close.withColumn("edits", F.levenshtein("term", F.lit(word)).cast("long")).where(F.col("edits") <= distance).where(F.col("term") != word)


def expand(query: str, synonyms: dict[str, list[str]]) -> str:
    """A query's words replaced by alternatives of their synonym groups."""
    group = {w: ws for ws in synonyms.values() for w in ws}
    return re.sub(r"[\w]+", lambda m: f"({'|'.join(group[m[0].lower()])})" if m[0].lower() in group else m[0], query)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, k: int = 60, count: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two whole results (doc, score), exact for the first `count`.

    A document past place k + 2 * count in both results scores less than 2 / (2 * (k + count)), which the first `count` of
    either reach alone. So these many of each are candidates; their places are counted, and nothing is sorted as a whole.
    """
    depth, both = k + 2 * count, []
    tops = [h.orderBy(F.col("score").desc(), "doc").limit(depth).select("doc") for h in (text_hits, vector_hits)]
    candidates = tops[0].union(tops[1]).distinct()
    for hits in (text_hits, vector_hits):
        mine = hits.join(F.broadcast(candidates), "doc").select("doc", "score")  # at most twice `depth`
        asked = mine.select(F.col("doc").alias("_doc"), F.col("score").alias("_score"))
        ahead = (F.col("score") > F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("doc") <= F.col("_doc")))
        both.append(hits.join(F.broadcast(asked), ahead).groupBy(F.col("_doc").alias("doc")).agg((F.lit(1.0) / (k + F.count("*"))).alias("part")))
    return both[0].unionByName(both[1]).groupBy("doc").agg(F.sum("part").alias("score")).orderBy(F.col("score").desc(), "doc").limit(count)
