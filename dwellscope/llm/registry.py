"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import decontaminate, exact_dedup, license_scan, near_dedup, pii, quality, substring_dedup, tokenizer, toxicity, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op3_pii": pii.op3_pii,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_quality": quality.op5_quality,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_sentencepiece": tokenizer.op7_sentencepiece,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_warc": warc.op9_warc,
}
ORACLE_SQL = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
}
