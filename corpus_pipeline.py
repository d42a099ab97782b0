"""Corpus pipeline: each stage reads what its predecessor kept."""

from __future__ import annotations

from claimloom.llm import bpe, decontam, jaccard, quality_rules, secrets, util

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("benchmark_decontamination", decontam.stage),
    ("secret_scans", secrets.stage),
    ("byte_bpe", bpe.stage),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = util.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = util.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
