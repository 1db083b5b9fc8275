"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from skyquill.llm import chat, decontaminate, html_text, jaccard_join, language_model, mixing, pipeline, quality_model, quality_rules, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_toxicity_chain": toxicity.op1_toxicity_chain,
        "op2_template_decontamination": decontaminate.op2_template_decontamination,
        "op3_tree_model_extraction": html_text.op3_tree_model_extraction,
        "op4_poisson_mixing": mixing.op4_poisson_mixing,
        "op5_quality_line_frequency": quality_rules.op5_quality_line_frequency,
        "op6_url_vocabulary": url_filter.op6_url_vocabulary,
        "op7_adaptive_prefix_join": jaccard_join.op7_adaptive_prefix_join,
        "op8_recurrent_lm": language_model.op8_recurrent_lm,
        "op9_subword_quality": quality_model.op9_subword_quality,
        "op10_chat_snapshot_collapse": chat.op10_chat_snapshot_collapse,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op4_poisson_mixing": mixing.ORACLE,
        "op5_quality_line_frequency": quality_rules.ORACLE,
        "op6_url_vocabulary": url_filter.ORACLE,
        "op7_adaptive_prefix_join": jaccard_join.ORACLE,
        "op10_chat_snapshot_collapse": chat.ORACLE,
    }
