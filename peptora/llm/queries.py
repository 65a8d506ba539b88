"""The corpus operators' registered queries, and their SQL where SQL expresses them."""

from __future__ import annotations

from peptora.llm import blocknames, dialogue, lmscore, lzprint, ogg, packing, phrases, pieces, quality, simhash, substring, toxicity, urlrules

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_quality": quality.op2_quality,
    "op3_ogg": ogg.op3_ogg,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_fingerprint": lzprint.op6_fingerprint,
    "op7_substring": substring.op7_substring,
    "op8_url_rules": urlrules.op8_url_rules,
    "op9_lm_scoring": lmscore.op9_lm_scoring,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_block_names": blocknames.op11_block_names,
    "op12_dialogue": dialogue.op12_dialogue,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE_SQL = {
    "op8_url_rules": urlrules.OP8_SQL,
    "op11_block_names": blocknames.OP11_SQL,
    "op12_dialogue": dialogue.OP12_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
