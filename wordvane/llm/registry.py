"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from wordvane.llm import exact_dedup, hard_negatives, hnsw, html_extract, language_id, mixing, packing, pii, pivot_search, shingle_join, url_filter, vector_codes, warc


def queries() -> dict:
    return {
        "op1_html": html_extract.op1_html,
        "op2_mixing": mixing.op2_mixing,
        "op3_hnsw": hnsw.op3_hnsw,
        "op4_shingle_join": shingle_join.op4_shingle_join,
        "op5_packing": packing.op5_packing,
        "op6_pii": pii.op6_pii,
        "op7_topk": pivot_search.op7_topk,
        "op8_warc": warc.op8_warc,
        "op9_language_id": language_id.op9_language_id,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_exact_dedup": exact_dedup.op12_exact_dedup,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.OP2_SQL,
        "op7_topk": pivot_search.OP7_SQL,
        "op8_warc": warc.OP8_SQL,
        "op10_url_filter": url_filter.op10_sql(),
        "op11_vector_codes": vector_codes.op11_sql(),
        "op12_exact_dedup": exact_dedup.OP12_SQL,
        "op13_hard_negatives": hard_negatives.OP13_SQL,
    }
