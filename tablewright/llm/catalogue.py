"""The subpackage's queries and their SQL, by name."""

from tablewright.llm import (
    exact_dedup, filter_audit, language, mixing, packing, pii, quality, simhash, suffix_dedup, topk, toxicity, url_filter, whitening,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_packing": packing.op4_packing,
    "op5_pii": pii.op5_pii,
    "op6_topk": topk.op6_topk,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality": quality.op9_quality,
    "op10_language": language.op10_language,
    "op11_whitening": whitening.op11_whitening,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op6_topk": topk.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
