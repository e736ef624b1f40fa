"""The registered queries of this subpackage and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from riskmill.llm.ann import op8_ann
from riskmill.llm.conversations import op11_conversation_repair
from riskmill.llm.decontaminate import op6_decontamination
from riskmill.llm.huffman_ids import op5_huffman_ids
from riskmill.llm.html_extract import op12_html_extraction
from riskmill.llm.language_id import op9_language_id
from riskmill.llm.line_dedup import op7_line_dedup
from riskmill.llm.near_dup import op4_near_dup
from riskmill.llm.ngram_trie import op3_lm_scores
from riskmill.llm.packing import op2_best_fit_packing
from riskmill.llm.quality import op1_quality
from riskmill.llm.sql import CONVERSATION_REPAIR, VECTOR_CODES
from riskmill.llm.token_counts import op10_token_counts
from riskmill.llm.vector_codes import op13_vector_codes

QUERIES = {
    "op1_quality": op1_quality,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_lm_scores": op3_lm_scores,
    "op4_near_dup": op4_near_dup,
    "op5_huffman_ids": op5_huffman_ids,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_ann": op8_ann,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_html_extraction": op12_html_extraction,
    "op13_vector_codes": op13_vector_codes,
}

#: The others rest on tokenizers, trained models or similarity joins that SQL cannot do over whole tables.
SQL = {"op11_conversation_repair": CONVERSATION_REPAIR, "op13_vector_codes": VECTOR_CODES}
