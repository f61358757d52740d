"""The queries of the corpus operators, and SQL for those that SQL can express."""

from rowlattice.llm import exact_dedup, jaccard, line_dedup, mixing, packing, pii, quality, secrets, sharding, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_line_spread": line_dedup.op2,
    "op3_secret_scan": secrets.op3,
    "op4_toxicity": toxicity.op4,
    "op5_feistel_sharding": sharding.op5,
    "op6_pii_contexts": pii.op6,
    "op7_entropy_mixing": mixing.op7,
    "op8_mcd_quality": quality.op8,
    "op9_exact_dedup": exact_dedup.op9,
    "op10_jaccard_join": jaccard.op10,
}
SQL = {
    "op2_line_spread": line_dedup.OP2_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_jaccard_join": jaccard.OP10_SQL,
}
