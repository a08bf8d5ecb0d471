"""Queries and SQL of the text operators, by name."""

from __future__ import annotations

from revcast.llm import bpe, chat_format, decontaminate, hard_negatives, license_scan, ngram_join, packing, quality_knn, sharding, slack_packing, substring_dedup, weak_quality, whitening

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_sharding": sharding.op2_sharding,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_weak_quality": weak_quality.op4_weak_quality,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_quality_knn": quality_knn.op9_quality_knn,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_whitening": whitening.op11_whitening,
    "op12_slack_packing": slack_packing.op12_slack_packing,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
SQL = {
    "op3_license_scan": license_scan.SQL,
    "op5_ngram_join": ngram_join.SQL,
    "op6_chat_format": chat_format.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
