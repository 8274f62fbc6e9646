"""The queries of this folder by name, and the SQL that expresses them where SQL can."""

from __future__ import annotations

from . import chat_format, jaccard_join, line_dedup, mixing, packing, pii, quality_rules, substring_dedup, topk_search, toxicity

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_pii": pii.op4_pii,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_mixing": mixing.op8_mixing,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLE_SQL = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op2_jaccard_join": jaccard_join.OP2_SQL,
    "op4_pii": pii.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op9_topk_search": topk_search.OP9_SQL,
}
