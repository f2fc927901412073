"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lodeframe.llm import graph_ann, language_id, mixing, packing, quality_rules, simhash, suffix_dedup, suffix_tree_lm, toxicity, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_toxicity": toxicity.op2,
    "op3_packing": packing.op3,
    "op4_simhash": simhash.op4,
    "op5_graph_ann": graph_ann.op5,
    "op6_language_id": language_id.op6,
    "op7_suffix_tree_lm": suffix_tree_lm.op7,
    "op8_mixing": mixing.op8,
    "op9_url_filter": url_filter.op9,
    "op10_quality_rules": quality_rules.op10,
}
ORACLE = {"op8_mixing": mixing.SQL, "op10_quality_rules": quality_rules.SQL}
