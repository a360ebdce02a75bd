"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from . import audit, bpe, chat, exactdup, html, jaccard, langid, merkle, mixing, repetition, search, secrets, toxicity


def queries() -> dict:
    return {
        "op1_secret_scans": secrets.op1_secret_scans,
        "op2_quality_rules": repetition.op2_quality_rules,
        "op3_source_mixing": mixing.op3_source_mixing,
        "op4_chat_format": chat.op4_chat_format,
        "op5_exact_topk": search.op5_exact_topk,
        "op6_html": html.op6_html,
        "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
        "op8_language_id": langid.op8_language_id,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_bpe": bpe.op10_bpe,
        "op11_exact_dedup": exactdup.op11_exact_dedup,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scans": secrets.ORACLE, "op4_chat_format": chat.ORACLE, "op5_exact_topk": search.ORACLE,
        "op11_exact_dedup": exactdup.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_filter_audit": audit.ORACLE,
    }
