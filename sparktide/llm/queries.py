"""Queries of the corpus operators: each over its whole table, with production parameters."""

from . import balltree, licenses, lm, minhash, mixing, packing, rpforest, sharding, substring, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1_query,
    "op2_substring_dedup": substring.op2_query,
    "op3_license_scan": licenses.op3_query,
    "op4_rp_forest_neighbours": rpforest.op4_query,
    "op5_hash_tree_sharding": sharding.op5_query,
    "op6_poisson_mixing": mixing.op6_query,
    "op7_toxicity": toxicity.op7_query,
    "op8_kneser_ney_perplexity": lm.op8_query,
    "op9_superminhash_near_dedup": minhash.op9_query,
    "op10_exact_top_k": balltree.op10_query,
}
ORACLE: dict[str, str] = {
    "op5_hash_tree_sharding": sharding.OP5_SQL,
    "op6_poisson_mixing": mixing.OP6_SQL,
    "op10_exact_top_k": balltree.OP10_SQL,
}
