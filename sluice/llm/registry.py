"""Queries and oracle SQL of this package, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, chat, conversation_repair, line_dedup, media, minhash_dedup, packing, periodic_runs, quality_classifier, quality_rules, suffix_dedup, token_files, window_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_media": media.query,
    "op3_packing": packing.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_minhash_dedup": minhash_dedup.query,
    "op6_quality_rules": quality_rules.query,
    "op7_chat": chat.query,
    "op8_bpe": bpe.query,
    "op9_token_files": token_files.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_window_dedup": window_dedup.query,
    "op13_conversation_repair": conversation_repair.query,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op7_chat": chat.ORACLE_SQL,
    "op12_window_dedup": window_dedup.ORACLE_SQL,
    "op13_conversation_repair": conversation_repair.ORACLE_SQL,
}
