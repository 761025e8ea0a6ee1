"""Queries of the corpus operators and the SQL that they are held against."""

from . import ann, decontamination, language, line_dedup, lm_scoring, mixing, secrets, simhash, substring_dedup, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_nearest_neighbours": ann.op3_nearest_neighbours,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_language_id": language.op6_language_id,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_benchmark_decontamination": decontamination.op10_benchmark_decontamination,
}

#: Only where SQL can express the operator; the others are tested against brute force in tests/llm.
ORACLE_SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op10_benchmark_decontamination": decontamination.OP10_SQL,
}
