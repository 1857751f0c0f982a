"""The queries of this subpackage and the SQL that checks them, by name."""

from tidemark.llm import bpe, chunk_dedup, decontaminate, hard_negatives, jaccard_join, language_id, line_frequency, merkle, preference, quality, sanitise, suffix_array, toxicity

QUERIES = {
    "op1_sanitise": sanitise.op1_sanitise,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chunk_dedup": chunk_dedup.op5_chunk_dedup,
    "op6_preference": preference.op6_preference,
    "op7_language_id": language_id.op7_language_id,
    "op8_line_frequency": line_frequency.op8_line_frequency,
    "op9_bpe": bpe.op9_bpe,
    "op10_suffix_array": suffix_array.op10_suffix_array,
    "op11_quality": quality.op11_quality,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES: dict[str, str] = {
    "op2_decontamination": decontaminate.OP2_SQL,
    "op3_jaccard_join": jaccard_join.OP3_SQL,
    "op6_preference": preference.OP6_SQL,
    "op8_line_frequency": line_frequency.OP8_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
