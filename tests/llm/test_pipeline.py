"""The stages of the pipeline one after the other, each against what it may change."""

import random
import re

import corpus_pipeline
from lodeframe.llm import suffix_dedup
from lodeframe.llm.common import written
from tests.llm.test_llm import prose


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    passage = prose(rng, 80)
    rows, labels = [], []
    for i in range(240):
        t = prose(rng, rng.randrange(80, 160))
        if i % 6 == 0:
            t += " schuft lump schuft grobian lump"
            labels.append((i, 1, 1))
        elif i % 2:
            labels.append((i, 1, 0))
        if i % 6 == 1:
            t += " " + passage
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(1000 + i, rows[i][1] + (" more" if i % 2 else ""), "en", "s0", 5) for i in (1, 2, 3)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, str(tmp_path)), "test")
        seen[name] = at
        if name != "packing":
            assert at.columns == corpus_pipeline.COLUMNS
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert not ids["toxicity"] & {i for i in range(0, 240, 6)} and len(ids["toxicity"]) == 200 + 3 + 2
    assert not ids["simhash_near_dedup"] & {1001, 1002, 1003}
    left = {r.doc_id: r.text for r in seen["suffix_array_dedup"].collect()}
    assert set(left) == ids["simhash_near_dedup"] and sum(passage[50:300] in (t or "") for t in left.values()) == 0
    assert suffix_dedup.removed(seen["simhash_near_dedup"]).where("n_removed > 0").count() >= 30
    assert ids["mixing"] <= ids["suffix_array_dedup"] and ids["packing"] == ids["mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()
    assert all(re.fullmatch(r"[a-z_]+", n) for n, _ in corpus_pipeline.STAGES)
