"""Queries of the numbered operators, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from .ann import op10_multi_index_hashing
from .audit import OP11_SQL, op11_filter_audit
from .bpe import op13_bpe_round_trip
from .chat import op2_chat_formatting
from .html import op3_html_extraction
from .jaccard import OP8_SQL, op8_ngram_jaccard_join
from .lexical import OP12_SQL, op12_block_max_search
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixing import op6_source_mixing
from .packing import op7_best_fit_packing
from .quality import op1_quality_rules
from .tokens import op5_token_counts
from .toxicity import op4_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_html_extraction": op3_html_extraction,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_source_mixing": op6_source_mixing,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_multi_index_hashing": op10_multi_index_hashing,
    "op11_filter_audit": op11_filter_audit,
    "op12_block_max_search": op12_block_max_search,
    "op13_bpe_round_trip": op13_bpe_round_trip,
}

#: Only where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op8_ngram_jaccard_join": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_block_max_search": OP12_SQL,
}
