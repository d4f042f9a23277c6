"""The queries of this subpackage and those of them that SQL can express."""

from __future__ import annotations

from revlume.llm import (
    op1_source_mix as op1,
    op10_recompression_dedup as op10,
    op11_phrase_counting as op11,
    op12_curve_packing as op12,
    op13_fill_in_middle as op13,
    op2_suffix_decontamination as op2,
    op3_attention_quality as op3,
    op4_license_digests as op4,
    op5_char_nb_toxicity as op5,
    op6_secret_index as op6,
    op7_lsh_forest as op7,
    op8_hilbert_shards as op8,
    op9_kmeans_tree as op9,
)

QUERIES = {
    "op1_source_mix": op1.op1_source_mix,
    "op2_suffix_decontamination": op2.op2_suffix_decontamination,
    "op3_attention_quality": op3.op3_attention_quality,
    "op4_license_digests": op4.op4_license_digests,
    "op5_char_nb_toxicity": op5.op5_char_nb_toxicity,
    "op6_secret_index": op6.op6_secret_index,
    "op7_lsh_forest": op7.op7_lsh_forest,
    "op8_hilbert_shards": op8.op8_hilbert_shards,
    "op9_kmeans_tree": op9.op9_kmeans_tree,
    "op10_recompression_dedup": op10.op10_recompression_dedup,
    "op11_phrase_counting": op11.op11_phrase_counting,
    "op12_curve_packing": op12.op12_curve_packing,
    "op13_fill_in_middle": op13.op13_fill_in_middle,
}

ORACLE = {
    "op1_source_mix": op1.OP1_SQL,
    "op2_suffix_decontamination": op2.OP2_SQL,
    "op4_license_digests": op4.OP4_SQL,
    "op6_secret_index": op6.OP6_SQL,
    "op10_recompression_dedup": op10.OP10_SQL,
    "op11_phrase_counting": op11.OP11_SQL,
    "op13_fill_in_middle": op13.OP13_SQL,
}
