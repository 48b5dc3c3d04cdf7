"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolesift.llm import bpe, decontamination, hard_negatives, html_text, langid, lattice, licences, lm, minhash, prefix_trie, secrets, token_shards, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": lm.op1_lm_score,
        "op2_minhash_dedup": minhash.op2_minhash_dedup,
        "op3_html_text": html_text.op3_html_text,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_language_id": langid.op5_language_id,
        "op6_token_shards": token_shards.op6_token_shards,
        "op7_lattice_dedup": lattice.op7_lattice_dedup,
        "op8_license_scan": licences.op8_license_scan,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_secret_scan": secrets.op11_secret_scan,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_decontamination": decontamination.ORACLE_SQL,
        "op11_secret_scan": secrets.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
        "op13_hard_negatives": hard_negatives.ORACLE_SQL,
    }
