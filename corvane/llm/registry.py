"""Queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from corvane.llm import bpe, decontaminate, lattice, mixmodel, mixture, prefixtrie, quality, repair, secretscan, shards, simhash, tokencount, warc

QUERIES = {
    "op1_quality": quality.query,
    "op2_context_mixing": mixmodel.query,
    "op3_sharding": shards.query,
    "op4_token_counts": tokencount.query,
    "op5_decontamination": decontaminate.query,
    "op6_lattice": lattice.query,
    "op7_mixing": mixture.query,
    "op8_warc": warc.query,
    "op9_simhash": simhash.query,
    "op10_secrets": secretscan.query,
    "op11_prefix_trie": prefixtrie.query,
    "op12_repair": repair.query,
    "op13_bpe": bpe.query,
}
ORACLE_SQL = {"op5_decontamination": decontaminate.ORACLE, "op6_lattice": lattice.ORACLE, "op8_warc": warc.ORACLE, "op11_prefix_trie": prefixtrie.ORACLE}
