"""Queries of the document operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from . import bpe, conversations, decontam, jaccard, licenses, quality_model, quality_rules, secrets, sharding, substrings, topk, trie, urls


def queries() -> dict:
    return {
        "op1_jaccard_join": jaccard.query,
        "op2_benchmark_decontamination": decontam.query,
        "op3_substring_dedup": substrings.query,
        "op4_license_scans": licenses.query,
        "op5_quality_classifier": quality_model.query,
        "op6_quality_rules": quality_rules.query,
        "op7_byte_bpe": bpe.query,
        "op8_secret_scans": secrets.query,
        "op9_url_filters": urls.query,
        "op10_sharding": sharding.query,
        "op11_conversation_repair": conversations.query,
        "op12_exact_top_k": topk.query,
        "op13_prefix_trie": trie.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": jaccard.SQL,
        "op3_substring_dedup": substrings.SQL,
        "op4_license_scans": licenses.sql(),
        "op9_url_filters": urls.SQL,
        "op11_conversation_repair": conversations.SQL,
        "op12_exact_top_k": topk.SQL,
        "op13_prefix_trie": trie.SQL,
    }
