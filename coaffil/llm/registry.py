"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, byte_bpe, embedding, exact_dedup, fim, packing, pii, sharding, simhash, suffix_dedup, toxicity, url_filter, whitening


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_embedding_near_dedup": embedding.op3_embedding_near_dedup,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_sharding": sharding.op5_sharding,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_packing": packing.op7_packing,
        "op8_pii": pii.op8_pii,
        "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
        "op10_bpe": bpe.op10_bpe,
        "op11_whitening": whitening.op11_whitening,
        "op12_byte_bpe": byte_bpe.op12_byte_bpe,
        "op13_fim": fim.op13_fim,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op4_url_filter": url_filter.SQL,
        "op13_fim": fim.SQL,
    }
