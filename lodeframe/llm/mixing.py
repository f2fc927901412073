"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents fall into cells (source, language, topic). Token weights of the cells are raked, margin by margin, to
target shares; documents are then sampled with calibrated probabilities: p = min(1, lambda * weight / share),
lambda being solved exactly so that the expected tokens meet the budget. A document's draw is a hash of its id,
so a retry or another partitioning draws alike.

Target shares are tempered by default: a value's share of all tokens to the power `temper`, normalised. Explicit
targets may be given per margin as {value: share}; values that have no tokens are left out and the rest scaled.

Up to `ONE_PARTITION` cells are raked by windows in one small partition, a single job. Beyond that each margin is an
aggregation of the cells, joined back, with a table written after each round, which ends when no margin is off by more
than `CLOSE`; lambda comes from repeated sums. Both ways give the same weights and probabilities.

Defined cases: null source or language counts as "unknown"; null and empty texts have no tokens, lie in topic
"empty" and are never drawn; very long texts count like any other; rows that repeat an id, or have none, are drawn together;
cells of equal ratios go by their names; extra columns are not read unless named in `keep`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.common import written

MARGINS = ("source", "lang", "topic")
#: Fixed values: (topic, pieces of text that mark it), first match first.
TOPICS = (
    ("legal", ("icense", "opyright", "arranty")),
    ("contact", ("@",)),
    ("markup", ("<", "{", "|")),
    ("query", ("?",)),
)
ROUNDS, TEMPER, BUDGET, SEED = 10, 0.5, 0.5, "mix"
#: Up to so many cells are raked in one partition and broadcast to the documents; more are shuffled instead.
ONE_PARTITION, CLOSE = 20_000, 1e-9


def topic(text: Column) -> Column:
    out = F.when(F.coalesce(F.octet_length(text), F.lit(0)) == 0, "empty")
    for name, marks in TOPICS:
        test = F.lit(False)
        for m in marks:
            test = test | F.contains(text, F.lit(m))
        out = out.when(test, name)
    return out.when(F.octet_length(text) < 600, "brief").when(F.octet_length(text) > 6000, "long").otherwise("prose")


def _targets(cells: DataFrame, margin: str, wanted: dict[str, float] | None, temper: float) -> DataFrame:
    """Adds the target share of each cell's value of `margin`."""
    w = Window.partitionBy(margin)
    if wanted is None:
        raw = F.pow(F.sum("tokens").over(w), F.lit(float(temper)))
    else:
        raw = F.coalesce(*[F.when(F.col(margin) == k, F.lit(float(v))) for k, v in wanted.items()], F.lit(0.0))
    # Each value counts once in the total, however many cells it has.
    cells = cells.withColumn("_raw", raw).withColumn("_once", F.when(F.row_number().over(w.orderBy(*MARGINS)) == 1, F.col("_raw")))
    return cells.withColumn(f"_t_{margin}", F.col("_raw") / F.sum("_once").over(Window.partitionBy("_all"))).drop("_raw", "_once")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER,
         rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """cells (source, lang, topic, tokens) with their raked `weight` and calibrated `probability`."""
    cells = cells.where("tokens > 0").withColumn("_all", F.lit(1))
    for m in MARGINS:
        cells = _targets(cells, m, (targets or {}).get(m), temper)
    cells = cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("_all")))
    for _ in range(rounds):
        for m in MARGINS:
            cells = cells.withColumn("weight", F.col("weight") * F.col(f"_t_{m}") / F.sum("weight").over(Window.partitionBy(m)))
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy("_all"))
    cells = cells.withColumn("_share", share).withColumn("_r", F.col("weight") / F.col("_share"))
    # Cells in falling order of r: those before a cell are clipped at 1 if that cell's lambda says so.
    w = Window.partitionBy("_all").orderBy(F.col("_r").desc(), *MARGINS)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    cells = cells.withColumn("_lam", (F.lit(float(budget)) - F.coalesce(F.sum("_share").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    ok = F.when(F.col("_lam") * F.col("_r") <= 1, F.col("_lam"))
    cells = cells.withColumn("_lambda", F.first(ok, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    p = F.least(F.lit(1.0), F.coalesce(F.col("_lambda") * F.col("_r"), F.lit(1.0)))
    return cells.select(*MARGINS, "tokens", "weight", p.alias("probability"))


def off(cells: DataFrame, margin: str) -> Column:
    """The largest difference between a margin's share of weight and its target, of sums (margin, weight, target)."""
    return F.coalesce(F.max(F.abs(F.col("weight") - F.col("target"))), F.lit(0.0))


def rake_large(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER,
               rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """What `rake` gives, for any number of cells, by aggregations."""
    cells = written(cells.where("tokens > 0"), "mix-cells")
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.select(*MARGINS, "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"))
    goals = {}
    for m in MARGINS:
        sums, wanted = cells.groupBy(m).agg(F.sum("tokens").alias("t")), (targets or {}).get(m)
        raw = F.pow("t", F.lit(float(temper))) if wanted is None else F.coalesce(*[F.when(F.col(m) == k, F.lit(float(v))) for k, v in wanted.items()], F.lit(0.0))
        sums = sums.select(m, raw.alias("target"))
        goals[m] = written(sums.select(m, (F.col("target") / sums.agg(F.sum("target")).first()[0]).alias("target")), f"mix-{m}")
    cells = cells.withColumn("share", F.col("tokens") / float(total)).withColumn("weight", F.col("share"))
    for _ in range(rounds):
        far = 0.0
        for m in MARGINS:
            sums = cells.groupBy(m).agg(F.sum("weight").alias("weight")).join(goals[m], m)
            far = max(far, sums.agg(off(sums, m)).first()[0])
            cells = cells.join(sums.select(m, (F.col("target") / F.col("weight")).alias("_by")), m).withColumn("weight", F.col("weight") * F.col("_by")).drop("_by")
        cells = written(cells, "mix-round")
        if far <= CLOSE:
            break
    # lambda: cells that it clips at 1 are taken out, and it is solved again for the others, until none is new.
    lam, clipped = budget, -1
    while True:
        over = F.col("weight") * lam >= F.col("share")
        r = cells.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("share"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if r[0] == clipped or not r[2]:
            break
        clipped, lam = r[0], (budget - r[1]) / r[2]
    p = F.least(F.lit(1.0), F.col("weight") / F.col("share") * lam)
    return cells.select(*MARGINS, "tokens", "weight", p.alias("probability"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, rounds: int = ROUNDS,
        budget: float = BUDGET, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        lang: str = "lang", keep: tuple[str, ...] = (), of_topic: Column | None = None) -> DataFrame:
    """of_topic: the documents' topics, where better ones are known than those of the rules in `TOPICS`. One row per document: its cell, tokens (a fourth of its bytes, rounded up), probability and whether it is drawn."""
    own = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("unknown")).alias("source"),
        F.coalesce(F.col(lang).cast("string"), F.lit("unknown")).alias("lang"), (topic(F.col(text)) if of_topic is None else F.coalesce(of_topic.cast("string"), F.lit("unknown"))).alias("topic"),
        F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long").alias("tokens"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep])
    cells = own.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    few = cells.limit(ONE_PARTITION + 1).count() <= ONE_PARTITION
    raked = rake(cells.coalesce(1), targets, temper, rounds, budget) if few else rake_large(cells, targets, temper, rounds, budget)
    raked = raked.select(*MARGINS, "probability")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)
    out = own.join(F.broadcast(raked) if few else raked, list(MARGINS), "left")
    return out.select(
        "doc_id", *MARGINS, "tokens", F.coalesce("probability", F.lit(0.0)).alias("probability"),
        (draw < F.coalesce("probability", F.lit(0.0))).alias("sampled"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def op8(spark, sf_dir: str) -> DataFrame:
    """Every document with its probability and draw, at the default targets."""
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("probability", F.round("probability", 9))


def _sql() -> str:
    marks = " ".join(f"WHEN {' OR '.join(f"contains(text, '{m}')" for m in ms)} THEN '{t}'" for t, ms in TOPICS)
    ctes = [
        f"""d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
          CASE WHEN coalesce(strlen(text), 0) = 0 THEN 'empty' {marks} WHEN strlen(text) < 600 THEN 'brief' WHEN strlen(text) > 6000 THEN 'long' ELSE 'prose' END AS topic,
          CAST(ceil(coalesce(strlen(text), 0) / 4) AS BIGINT) AS tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for m in MARGINS:
        ctes.append(f"t_{m} AS (SELECT {m}, pow(sum(tokens), {TEMPER}) / sum(pow(sum(tokens), {TEMPER})) OVER () AS t_{m} FROM c GROUP BY {m})")
    ctes.append("w0 AS (SELECT *, tokens / sum(tokens) OVER () AS w, tokens / sum(tokens) OVER () AS share FROM c " + " ".join(f"JOIN t_{m} USING ({m})" for m in MARGINS) + ")")
    k = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{m} / sum(w) OVER (PARTITION BY {m}) AS w) FROM w{k})")
            k += 1
    order = "ORDER BY w / share DESC, source, lang, topic"
    ctes.append(f"""l AS (SELECT *, ({BUDGET} - coalesce(sum(share) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM w{k})""")
    ctes.append(f"b AS (SELECT lam FROM l WHERE lam * w / share <= 1 {order} LIMIT 1)")
    ctes.append("p AS (SELECT source, lang, topic, least(1.0, coalesce((SELECT lam FROM b) * w / share, 1.0)) AS p FROM l)")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, source, lang, topic, d.tokens AS tokens, round(coalesce(p, 0.0), 9) AS probability,
  coalesce(('0x' || substr(md5('{SEED}:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < p, false) AS sampled
FROM d LEFT JOIN p USING (source, lang, topic)"""


SQL = _sql()
