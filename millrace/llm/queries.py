"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from . import fingerprint, jaccard, language, lm_score, mixing, packing, pii, quality, resample, substrings, topk, toxicity, vector_codes

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_language": language.op4_language,
    "op5_substrings": substrings.op5_substrings,
    "op6_topk": topk.op6_topk,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_packing": packing.op9_packing,
    "op10_fingerprint": fingerprint.op10_fingerprint,
    "op11_resample": resample.op11_resample,
    "op12_pii": pii.op12_pii,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op6_topk": topk.OP6_SQL,
    "op11_resample": resample.OP11_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
