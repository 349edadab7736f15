"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import code_gemm, lexical, line_dedup, mixing, ngram_join, norm_topk, packing, quality, secrets, sharding, sstable, toxicity, winnowing

QUERIES = {
    "op1_label_propagation": sharding.op1,
    "op2_norm_topk": norm_topk.op2,
    "op3_bin_completion": packing.op3,
    "op4_sstable": sstable.op4,
    "op5_secret_links": secrets.op5,
    "op6_quality_rules": quality.op6,
    "op7_sainte_lague": mixing.op7,
    "op8_prefix_tree_join": ngram_join.op8,
    "op9_toxicity": toxicity.op9,
    "op10_line_spread": line_dedup.op10,
    "op11_code_gemm": code_gemm.op11,
    "op12_winnowing": winnowing.op12,
    "op13_range_maximum_search": lexical.op13,
}

#: Queries that SQL can't express are tested against brute force in tests/llm.
SQL = {
    "op2_norm_topk": norm_topk.OP2_SQL,
    "op10_line_spread": line_dedup.OP10_SQL,
    "op11_code_gemm": code_gemm.OP11_SQL,
    "op12_winnowing": winnowing.OP12_SQL,
    "op13_range_maximum_search": lexical.OP13_SQL,
}
