"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import alignment, bpe, divergence, exact_dedup, fingerprints, licenses, line_dedup, ngram_join, packing, sharding, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_bpe": bpe.op2_bpe,
    "op3_sharding": sharding.op3_sharding,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_packing": packing.op6_packing,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_alignment": alignment.op11_alignment,
    "op12_divergence": divergence.op12_divergence,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}
ORACLE = {
    "op7_line_dedup": line_dedup.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_substring_dedup": substring_dedup.ORACLE,
}
