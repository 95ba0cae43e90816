"""Registry of the corpus queries and their SQL."""

from __future__ import annotations

from trellis.llm import chat_format, exact_dedup, license_scan, packing, scaled_sketch, simhash_bk, sp_codec, substring_index, suffix_dedup, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_harmonic_packing": packing.op2_harmonic_packing,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_substring_dedup": substring_index.op4_substring_dedup,
    "op5_simhash_bk_tree": simhash_bk.op5_simhash_bk_tree,
    "op10_scaled_fingerprints": scaled_sketch.op10_scaled_fingerprints,
    "op6_chat_template": chat_format.op6_chat_template,
    "op7_sentencepiece_dropout": sp_codec.op7_sentencepiece_dropout,
    "op8_string_kernel_toxicity": toxicity.op8_string_kernel_toxicity,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_substring_dedup": substring_index.ORACLE,
    "op6_chat_template": chat_format.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
}
