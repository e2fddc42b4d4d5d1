"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from rtlake.llm import counts, fingerprints, language, lines, mixing, near, negatives, neighbours, pieces, quality, repair, rules, toxicity

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op10_minhash": near.op10_minhash,
    "op11_negatives": negatives.op11_negatives,
    "op12_rules": rules.op12_rules,
    "op13_repair": repair.op13_repair,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_token_counts": counts.op5_token_counts,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_quality": quality.op7_quality,
    "op8_mixing": mixing.op8_mixing,
    "op9_language_id": language.op9_language_id,
}
ORACLES = {"op10_minhash": near.OP10_SQL, "op11_negatives": negatives.OP11_SQL, "op12_rules": rules.OP12_SQL, "op6_line_dedup": lines.OP6_SQL, "op8_mixing": mixing.OP8_SQL}
