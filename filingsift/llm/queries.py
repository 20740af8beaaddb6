"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB statements."""
from filingsift.llm import (decontaminate, html_extraction, knn_join, language_id, license_scan, near_dedup, piece_sampling,
                            source_mixing, substring_dedup, token_alignment, toxicity, url_filter, vector_codes)

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_language_id": language_id.op4_language_id,
    "op5_sentencepiece": piece_sampling.op5_sentencepiece,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_topk_search": knn_join.op7_topk_search,
    "op8_html_extraction": html_extraction.op8_html_extraction,
    "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_source_mixing": source_mixing.op12_source_mixing,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLES = {
    "op2_url_filter": url_filter.OP2_SQL,
    "op3_benchmark_decontamination": decontaminate.OP3_SQL,
    "op7_topk_search": knn_join.OP7_SQL,
    "op9_minhash_near_dedup": near_dedup.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
}
