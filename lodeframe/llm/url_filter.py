"""URL filters: host and path rules, then gradient-boosted trees on lexical features.

Everything is a DataFrame expression. The trees are trained by Spark's own learner on a bounded sample of
labelled URLs (`SAMPLE` rows, those with the smallest hash of their id) and then compiled into one Column of
nested CASE expressions, so judging the URLs is a map-only projection.

A URL is labelled by the document its path ends in: bad if that document's label says low quality or toxic.
Statistics of host suffixes cover all labelled URLs; a row that the trees learn from sees its suffix without the
fold of rows that it belongs to. Their table is broadcast up to a checked size.

Defined cases: a null URL, or one without "://", has an empty host and path and fits no rule. Repeated rows are
judged each on its own, and so are rows without an id. A very long URL is one value like any other. Of rules of equal
length the last in the order of their text wins; a suffix without labels counts as one half. Extra columns are not read.
Without labelled URLs of both kinds the trees are empty and allow everything. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import hinted, written

SAMPLE, TREES, DEPTH, SEED, FOLDS = 20_000, 12, 3, 7, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (verdict, host, path) of the rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (as text), and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    gone = lambda s, chars: (F.length(s) - F.length(F.translate(s, chars, ""))).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)

    def entropy(s: Column) -> Column:
        share = lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / n
        return F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda a, c: F.when(F.length(c) == 0, a).otherwise(a - share(c) * F.log2(share(c))))

    return {
        "length": n,
        "host_length": F.length(host).cast("double"),
        "path_depth": gone(path, "/"),
        "host_depth": gone(host, "."),
        "digit_ratio": gone(u, "0123456789") / n,
        "punct_ratio": gone(u, "-_~%+=&;,") / n,
        "entropy": entropy(u),
        "params": F.when(query == "", 0.0).otherwise(gone(query, "&") + 1.0),
        "fragment": F.contains(u, F.lit("#")).cast("double"),
        "secure": u.startswith("https").cast("double"),
    }


def compile_trees(debug: str, weights: list[float], columns: list[str]) -> Column:
    """The weighted sum of the trees of a model, read from its description, as one expression."""
    lines = [x.strip() for x in debug.splitlines()[1:] if x.strip()]
    at = 0

    def node() -> Column:
        nonlocal at
        line = lines[at]
        at += 1
        if m := re.match(r"Predict: (\S+)", line):
            return F.lit(float(m[1]))
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        at += 1  # the Else line
        right = node()
        return F.when(F.col(columns[int(m[1])]) <= float(m[2]), left).otherwise(right)

    total, tree = F.lit(0.0), 0
    while at < len(lines):
        at += 1  # "Tree n (weight w):"
        total, tree = total + node() * weights[tree], tree + 1
    return total


def vectors(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_v").transform(rows)


def fit(labelled: DataFrame, columns: list[str], trees: int = TREES, depth: int = DEPTH) -> GBTClassificationModel:
    return GBTClassifier(featuresCol="_v", labelCol="bad", maxIter=trees, maxDepth=depth, seed=SEED).fit(vectors(labelled, columns).select("_v", "bad"))


def train(labelled: DataFrame, columns: list[str], trees: int = TREES, depth: int = DEPTH) -> Column:
    """Fits the trees to rows with a `bad` of 0.0 or 1.0; an expression that is above 0 for bad URLs."""
    if labelled.select("bad").distinct().count() < 2:
        return F.lit(-1.0)
    model = fit(labelled, columns, trees, depth)
    return compile_trees(model.toDebugString, list(model.treeWeights), columns)


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None, page_id: str = "page_id",
          url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """One row per page: host, path, rule, the trees' score, and the verdict."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumn("host", host).withColumn("path", path)
    seen = seen.withColumn("_suffix", F.element_at(F.split("host", r"\."), -1))
    named = features(F.col("url"), F.col("host"), F.col("path"))
    for name, c in named.items():
        seen = seen.withColumn(f"_f_{name}", c)
    bad = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("double")).alias("bad"))
    doc = F.regexp_extract("path", r"/(\d{1,18})(?:\.\w+|/)?$", 1)
    labelled = seen.withColumn("doc_id", F.when(doc != "", doc.cast("long"))).join(bad.where("bad IS NOT NULL"), "doc_id")
    fold = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(FOLDS))
    by_fold = [F.sum(F.when(fold == k, x)) for k in range(FOLDS) for x in (F.col("bad"), F.lit(1))]
    suffixes = labelled.groupBy("_suffix").agg(F.sum("bad").alias("_bad"), F.count("*").alias("_n"), F.array(*by_fold).alias("_folds"))
    suffixes = written(suffixes, "url-suffixes")
    # A suffix's share of bad URLs, drawn towards one half by ten rows' worth.
    share = lambda bad, n: F.coalesce((bad + 5.0) / (n + 10.0), F.lit(0.5))
    with_suffix = lambda df: df.join(hinted(suffixes), "_suffix", "left")
    columns = [f"_f_{x}" for x in named] + ["_f_suffix"]
    drawn = labelled.orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(sample)
    own = [F.coalesce(F.element_at("_folds", (2 * fold + k).cast("int")), F.lit(0.0)) for k in (1, 2)]
    held = with_suffix(drawn).withColumn("_f_suffix", share(F.col("_bad") - own[0], F.col("_n") - own[1])).select("bad", *columns).persist()
    try:
        score = train(held, columns)
    finally:
        held.unpersist()
    rule, verdict = rule_columns(F.col("host"), F.col("path"), RULES if rules is None else rules)
    out = with_suffix(seen).withColumn("_f_suffix", share(F.col("_bad"), F.col("_n"))).withColumn("bad_score", score)
    return out.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad_score") > 0, "block").otherwise("allow")).alias("verdict"), "bad_score")


def op9(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
