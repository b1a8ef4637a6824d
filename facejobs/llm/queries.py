"""Queries and oracle SQL of this package, for ``__spark_entry__.py``."""

from __future__ import annotations

from facejobs.llm import audit, bond, huffman, licences, media, packing, quality_fm, quality_rules, sentencepieces, simhash, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_license_scans": licences.query,
        "op3_toxicity": toxicity.query,
        "op4_simhash_near_dedup": simhash.query,
        "op5_quality_classifier": quality_fm.query,
        "op6_sentencepiece": sentencepieces.query,
        "op7_token_counts": token_counts.query,
        "op8_token_files": huffman.query,
        "op9_best_fit_packing": packing.query,
        "op10_media_columns": media.query,
        "op11_hard_negatives": bond.query,
        "op12_filter_audit": audit.query,
        "op13_warc": warc.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.SQL,
        "op2_license_scans": licences.SQL,
        "op11_hard_negatives": bond.SQL,
        "op12_filter_audit": audit.SQL,
        "op13_warc": warc.SQL,
    }
