"""The queries of this folder, for ``__spark_entry__.py``, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tallywright.llm import (
    bpe,
    exact_search,
    langid,
    licenses,
    line_dedup,
    merkle,
    mixing,
    page_text,
    pii,
    simhash,
    tree_search,
    urls,
    vector_codes,
)

LLM_QUERIES = {
    "op1_exact_topk": exact_search.op1_exact_topk,
    "op2_personal_data": pii.op2_personal_data,
    "op3_html": page_text.op3_html,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_url_filter": urls.op5_url_filter,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_tree_search": tree_search.op7_tree_search,
    "op8_mixing": mixing.op8_mixing,
    "op9_language_id": langid.op9_language_id,
    "op10_simhash": simhash.op10_simhash,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_merkle": merkle.op12_merkle,
    "op13_license_scan": licenses.op13_license_scan,
    "pipeline": corpus_pipeline.run,
}
LLM_SQL: dict[str, str] = {
    "op1_exact_topk": exact_search.OP1_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_merkle": merkle.OP12_SQL,
    "op13_license_scan": licenses.OP13_SQL,
}
