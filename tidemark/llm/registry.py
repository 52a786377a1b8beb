"""The registered queries of the training-data operators and their SQL."""

from . import block_names, decontaminate, hmm_lm, mixing, resampling, revisits, simhash, token_codes, toxicity, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_toxicity_crf": toxicity.op2_toxicity_crf,
    "op3_simhash_golay": simhash.op3_simhash_golay,
    "op4_token_codes": token_codes.op4_token_codes,
    "op5_hmm_lm": hmm_lm.op5_hmm_lm,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_exact_dedup": block_names.op7_exact_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_revisits": revisits.op9_revisits,
    "op10_importance_resampling": resampling.op10_importance_resampling,
}

ORACLES = {
    "op6_url_filter": url_filter.ORACLE,
    "op7_exact_dedup": block_names.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_revisits": revisits.ORACLE,
}
