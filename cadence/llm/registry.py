"""Named queries of the training-data operators and their SQL."""

from __future__ import annotations

from cadence.llm import (byte_bpe, chat_format, exact_dedup, jaccard_join, language_id, merkle, packing, passages, periodic_runs, quality_classifier,
                         quality_rules, sharding, suffix_dedup)


def queries():
    return {
        "op1_adaptive_quality_rules": quality_rules.op1_adaptive_quality_rules,
        "op2_bucket_pointer_dedup": suffix_dedup.op2_bucket_pointer_dedup,
        "op3_compact_windows": passages.op3_compact_windows,
        "op4_bayes_quality_classifier": quality_classifier.op4_bayes_quality_classifier,
        "op5_byte_bpe": byte_bpe.op5_byte_bpe,
        "op6_block_naming_dedup": exact_dedup.op6_block_naming_dedup,
        "op9_prefix_tree_jaccard": jaccard_join.op9_prefix_tree_jaccard,
        "op10_mixture_packing": packing.op10_mixture_packing,
        "op7_word_backoff_langid": language_id.op7_word_backoff_langid,
        "op8_jump_hash_sharding": sharding.op8_jump_hash_sharding,
        "op11_chat_prefix_tree": chat_format.op11_chat_prefix_tree,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql():
    return {
        "op6_block_naming_dedup": exact_dedup.ORACLE_SQL,
        "op9_prefix_tree_jaccard": jaccard_join.ORACLE_SQL,
        "op11_chat_prefix_tree": chat_format.ORACLE_SQL,
        "op12_merkle_manifest": merkle.ORACLE_SQL,
        "op13_periodic_runs": periodic_runs.ORACLE_SQL,
    }
