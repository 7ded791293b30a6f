"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, classifier, decontaminate, html_extract, lm_scoring, near_dedup, packing, quality_rules, substring_dedup, warc

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_warc": warc.op2_warc,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_minhash_near_dedup": near_dedup.op4_minhash_near_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_quality_classifier": classifier.op8_quality_classifier,
    "op9_html_extraction": html_extract.op9_html_extraction,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "quality_ablation": quality_rules.quality_ablation,
}

ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": decontaminate.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op6_chat_formatting": chat.OP6_SQL,
    "quality_ablation": quality_rules.ABLATION_SQL,
}
