"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, jaccard_join, ngram_lm, packing, quality_rules, sharding, token_count, toxicity, url_filter

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_token_count": token_count.op3_token_count,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_ngram_lm": ngram_lm.op5_ngram_lm,
    "op6_sharding": sharding.op6_sharding,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_packing": packing.op9_packing,
    "op10_url_filter": url_filter.op10_url_filter,
}
SQL = {"op1_chat_format": chat_format.OP1_SQL}
