"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontamination, exact_dedup, licenses, mixing, passages, personal, quality, quotations, sharding, simhash

QUERIES = {
    "op1_bounded_ring": sharding.sharding_query,
    "op2_prefix_join": decontamination.decontamination_query,
    "op3_ordinal_quality": quality.quality_query,
    "op4_skip_chain_crf": personal.personal_query,
    "op5_paragraph_minhash": passages.passages_query,
    "op6_quotient_filter": exact_dedup.exact_dedup_query,
    "op7_systematic_mix": mixing.mixing_query,
    "op8_license_rules": licenses.licenses_query,
    "op9_quotation_links": quotations.conversations_query,
    "op10_simhash_vp_tree": simhash.simhash_query,
}

ORACLE_SQL = {
    "op2_prefix_join": decontamination.DECONTAMINATION_SQL,
    "op6_quotient_filter": exact_dedup.EXACT_DEDUP_SQL,
    "op7_systematic_mix": mixing.MIXING_SQL,
    "op9_quotation_links": quotations.QUOTATIONS_SQL,
}
