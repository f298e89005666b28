"""The registered queries of the corpus operators, and the SQL that gives the same rows."""

from kvlake.llm import decontamination, embedding_dedup, html_extraction, licenses, mixing, ngram_join, pii, quality, secrets, toxicity

QUERIES = {
    "op1_disclosure": pii.op1_disclosure,
    "op2_spaced_seeds": decontamination.op2_spaced_seeds,
    "op3_projection_forest": embedding_dedup.op3_projection_forest,
    "op4_guess_cost": secrets.op4_guess_cost,
    "op5_prefix_join": ngram_join.op5_prefix_join,
    "op6_ftrl_quality": quality.op6_ftrl_quality,
    "op7_signature_rules": licenses.op7_signature_rules,
    "op8_string_kernel": toxicity.op8_string_kernel,
    "op9_boosted_dom": html_extraction.op9_boosted_dom,
    "op10_poisson_mix": mixing.op10_poisson_mix,
}
SQL = {
    "op3_projection_forest": embedding_dedup.OP3_SQL,
    "op5_prefix_join": ngram_join.OP5_SQL,
    "op10_poisson_mix": mixing.OP10_SQL,
}
