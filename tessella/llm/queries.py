"""Queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from . import bpe, chat, lm, packing, periods, quality, rules, sharding, simhash, sitetree, topk, toxicity, voronoi

QUERIES = {
    "op1_quality_classifier": quality.op1_quality,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_rendezvous_sharding": sharding.op3_sharding,
    "op4_chat_tool_calls": chat.op4_chat,
    "op5_simhash_pivots": simhash.op5_simhash,
    "op6_lm_deleted_interpolation": lm.op6_lm,
    "op7_toxicity_compression": toxicity.op7_toxicity,
    "op8_sum_of_squares_packing": packing.op8_packing,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_pivot_topk": topk.op10_topk,
    "op11_hard_negatives": voronoi.op11_hard_negatives,
    "op12_site_style_tree": sitetree.op12_html,
    "op13_periodic_runs": periods.op13_periods,
    "quality_rule_ablations": rules.quality_rule_ablations,
}

ORACLES = {
    "op4_chat_tool_calls": chat.ORACLE,
    "op9_quality_rules": rules.ORACLE,
    "op10_pivot_topk": topk.ORACLE,
    "op11_hard_negatives": voronoi.ORACLE,
    "quality_rule_ablations": rules.ABLATIONS,
}
