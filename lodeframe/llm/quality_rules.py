"""Quality rules: a threshold table compiled into one projection.

Each rule is a row (name, metric, comparison, threshold); a document fails a rule when the comparison holds.
Metrics are Column expressions over built-in functions, so the whole table becomes one map-only Spark plan
without user functions and without a shuffle.

Defined cases: a null text counts as having no words and fails `few_words`; an empty text likewise. Repeated
rows are judged each on its own. Extra columns are kept only if named in `keep`; columns of the input that
bear a metric's name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import SPACE, words

#: Frequent function words of the languages in hand.
STOP_WORDS = {
    "en": "the of and to in is was with that by for on a it as from are this be an or at not",
    "de": "der die das und in den von zu mit ist des ein eine auf im dem für nicht sich auch als",
    "fr": "le la les de des et un une du en que est dans pour il sur qui pas au par ne se",
    "es": "el la los de que y en un una del las por con se no es para al lo como su",
}
STOPS = sorted({x for v in STOP_WORDS.values() for w in v.split() for x in (w, w.capitalize())})

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

#: (rule, metric, comparison, threshold); ratios are per word, line ratios per line that has a word.
THRESHOLDS: list[tuple[str, str, str, float]] = [
    ("few_words", "n_words", "<", 50),
    ("repeated_windows", "repeat_ratio", ">", 0.5),
    ("short_words", "mean_word_length", "<", 2.0),
    ("long_words", "mean_word_length", ">", 15.0),
    ("symbols", "symbol_ratio", ">", 0.2),
    ("no_stop_words", "stop_ratio", "<", 0.02),
    ("repeated_lines", "dup_line_ratio", ">", 0.5),
]


def _metrics(df: DataFrame, text: str) -> DataFrame:
    """Adds the base counts. Staged, so that each intermediate array is made once."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_w", words(F.col(text)))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    # Symbols are one byte each, so byte lengths tell how many there were.
    df = df.withColumn("n_symbols", sum((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit("")))) for c in SYMBOLS).cast("long"))
    df = df.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_lines", F.size("_l").cast("long"))
    df = df.withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("_l"))).cast("long"))
    df = df.withColumn("n_stop_words", F.size(F.filter("_w", lambda w: w.isin(STOPS))).cast("long"))
    # Hashes of the windows of three words, then those hashes that occur again: neighbours in the sorted array.
    df = df.withColumn("_h", F.expr(
        "CASE WHEN n_words < 3 THEN cast(array() AS array<bigint>)"
        " ELSE transform(sequence(0, cast(n_words AS int) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"))
    df = df.withColumn("_s", F.sort_array("_h"))
    df = df.withColumn("_d", F.expr("array_distinct(filter(_s, (x, j) -> j > 0 AND x = _s[greatest(j - 1, 0)]))"))
    # Few such hashes are looked up one by one; for many, windows are sorted with their places instead.
    df = df.withColumn("_at", F.expr(
        "CASE WHEN size(_d) = 0 THEN cast(array() AS array<int>)"
        " WHEN size(_d) <= 16 THEN filter(transform(_h, (x, i) -> if(array_contains(_d, x), i, -1)), i -> i >= 0)"
        " ELSE transform(filter(array_sort(transform(_h, (x, i) -> struct(x AS h, i AS i))), (x, j) -> element_at(_s, j + 1) = x.h"
        " AND ((j > 0 AND _s[greatest(j - 1, 0)] = x.h) OR (j < size(_s) - 1 AND _s[least(j + 1, size(_s) - 1)] = x.h))), x -> x.i) END"))
    return df.withColumn("n_repeat_words", F.expr(
        "cast(size(array_distinct(flatten(transform(_at, i -> array(i, i + 1, i + 2))))) AS long)"))


def _ratios() -> dict[str, Column]:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "repeat_ratio": per_word("n_repeat_words"),
        "mean_word_length": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "stop_ratio": per_word("n_stop_words"),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def compile_rules(thresholds: list[tuple[str, str, str, float]], metrics: dict[str, Column]) -> Column:
    """The names of the rules that a row fails, as one array expression."""
    tests = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
    cases = [F.when(tests[op](metrics[m], F.lit(float(x))), F.lit(name)) for name, m, op, x in thresholds]
    return F.filter(F.array(*cases), lambda x: x.isNotNull())


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  thresholds: list[tuple[str, str, str, float]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: counts, the rules it fails, and whether it is kept (it fails none)."""
    table = THRESHOLDS if thresholds is None else thresholds
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    out = _metrics(own, "_text").withColumn("failed_rules", compile_rules(table, _ratios()))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        "failed_rules", (F.size("failed_rules") == 0).alias("kept"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def op10(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole documents table."""
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"))


def _sql() -> str:
    stops = ", ".join("'" + w + "'" for w in STOPS)
    r = [(n, {"n_words": "n_words", "repeat_ratio": "n_repeat_words / greatest(n_words, 1)", "mean_word_length": "word_chars / greatest(n_words, 1)",
              "symbol_ratio": "n_symbols / greatest(n_words, 1)", "stop_ratio": "n_stop / greatest(n_words, 1)",
              "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)"}[m], op, x) for n, m, op, x in THRESHOLDS]
    fails = ", ".join(f"CASE WHEN {e} {op} {x} THEN '{n}' END" for n, e, op, x in r)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
c AS (SELECT doc_id, ws, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        len(list_filter(ws, lambda x: x IN ({stops})))::BIGINT AS n_stop FROM w),
u AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM c),
e AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM e WHERE c IS NOT NULL),
g AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE f.n > 1 GROUP BY 1),
h AS (SELECT c.*, coalesce(g.n, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN g USING (doc_id)),
j AS (SELECT *, list_filter([{fails}], lambda x: x IS NOT NULL) AS fr,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(fr) = 0 AS kept, array_to_string(fr, ',') AS failed_rules FROM j"""


SQL = _sql()
