"""Queries of this subpackage and the SQL that they are compared with."""

from __future__ import annotations

from lectern.llm import bpe, centroids, collocations, exact_dedup, hmm, line_dedup, near_dedup, packing, piece_bpe, quality_classifier, quality_rules, token_store, warc_archive


def queries():
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality_classifier": quality_classifier.query,
        "op2_line_dedup": line_dedup.query,
        "op3_warc": warc_archive.query,
        "op4_packing": packing.query,
        "op5_exact_dedup": exact_dedup.query,
        "op6_token_store": token_store.query,
        "op7_bpe": bpe.query,
        "op8_quality_rules": quality_rules.query,
        "op9_hmm": hmm.query,
        "op10_minhash_dedup": near_dedup.query,
        "op11_collocations": collocations.query,
        "op12_sentencepiece": piece_bpe.query,
        "op13_centroids": centroids.query,
    }


def oracle_sql():
    return {
        "op2_line_dedup": line_dedup.ORACLE,
        "op3_warc": warc_archive.ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op8_quality_rules": quality_rules.ORACLE,
        "op11_collocations": collocations.ORACLE,
    }
