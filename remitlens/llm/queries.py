"""Registered queries of the package and their SQL."""

from __future__ import annotations

from . import (
    bpe_tree,
    chat_collapse,
    concat_cut,
    host_quality,
    lattice_dedup,
    lsh_forest,
    merkle,
    packing,
    prefix_trie,
    source_mix,
    suffix_dedup,
    token_counts,
    url_filter,
)

QUERIES = {
    "op1_lattice_dedup": lattice_dedup.op1_lattice_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_host_quality": host_quality.op4_host_quality,
    "op5_bpe_tree": bpe_tree.op5_bpe_tree,
    "op6_packing": packing.op6_packing,
    "op7_lsh_forest": lsh_forest.op7_lsh_forest,
    "op8_source_mix": source_mix.op8_source_mix,
    "op9_chat_collapse": chat_collapse.op9_chat_collapse,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_concat_cut": concat_cut.op12_concat_cut,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE = {
    "op4_host_quality": host_quality.ORACLE,
    "op8_source_mix": source_mix.ORACLE,
    "op9_chat_collapse": chat_collapse.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
