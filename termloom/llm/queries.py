"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from termloom.llm import audio, bpe, chat, jaccard, line_quality, line_spread, packing, sharding, substrings, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_line_quality": line_quality.op2_line_quality,
    "line_quality_low_limit": line_quality.line_quality_low_limit,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_bpe": bpe.op4_bpe,
    "bpe_roundtrip": bpe.bpe_roundtrip,
    "op5_chat_turns": chat.op5_chat_turns,
    "op6_line_spread": line_spread.op6_line_spread,
    "op7_chroma_prints": audio.op7_chroma_prints,
    "op8_best_fit": packing.op8_best_fit,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_substring_dedup": substrings.op10_substring_dedup,
}
SQL = {
    "bpe_roundtrip": bpe.SQL_ROUNDTRIP,
    "op2_line_quality": line_quality.SQL_OP2,
    "line_quality_low_limit": line_quality.SQL_LOW_LIMIT,
    "op5_chat_turns": chat.SQL_OP5,
    "op6_line_spread": line_spread.SQL_OP6,
}
