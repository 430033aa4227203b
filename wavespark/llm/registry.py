"""Queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from . import collocations, exact_dedup, langid, merkle, packing, pii, preferences, sharding, simhash, tiling, tokencache, toxicity, urlfilter

QUERIES = {
    "op1_redirect_rules": urlfilter.op1_redirect_rules,
    "redirected_pages": urlfilter.redirected_pages,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_pii_boosting": pii.op3_pii_boosting,
    "op4_toxicity_mil": toxicity.op4_toxicity_mil,
    "op5_greedy_tiling": tiling.op5_greedy_tiling,
    "op6_simhash_golay": simhash.op6_simhash_golay,
    "op7_preference_pairs": preferences.op7_preference_pairs,
    "op8_language_bitmask": langid.op8_language_bitmask,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_extendible_sharding": sharding.op10_extendible_sharding,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_digest_cache": tokencache.op12_digest_cache,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op1_redirect_rules": urlfilter.OP1_SQL,
    "redirected_pages": urlfilter.REDIRECTED_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op7_preference_pairs": preferences.OP7_SQL,
    "op10_extendible_sharding": sharding.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
