"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import fingerprints, jaccard, media, mixing, oracles, packing, sharding, spans, suffixes, toxicity, trees

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_quality": trees.op2_quality,
    "op3_media": media.op3_media,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_sharding": sharding.op5_sharding,
    "op6_mixing": mixing.op6_mixing,
    "op7_substring_dedup": spans.op7_substring_dedup,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES: dict[str, str] = {"op4_ngram_jaccard": oracles.NGRAM_JACCARD, "op8_suffix_dedup": oracles.SUFFIX_DEDUP}
