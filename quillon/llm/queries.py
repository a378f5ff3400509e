"""The thin queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from quillon.llm.alignment import op12_token_alignment
from quillon.llm.audit import OP11_SQL, op11_filter_audit
from quillon.llm.chat import OP9_SQL, op9_chat_format
from quillon.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from quillon.llm.media import op2_media_columns
from quillon.llm.mixing import OP4_SQL, op4_source_mixing
from quillon.llm.ngram_join import OP10_SQL, op10_ngram_join
from quillon.llm.pieces import op8_sentencepiece
from quillon.llm.quality import op5_quality_classifier
from quillon.llm.sharding import op3_sharding
from quillon.llm.simhash import op13_simhash
from quillon.llm.substring import OP7_SQL, op7_substring_dedup
from quillon.llm.urls import op6_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_media_columns,
        op3_sharding,
        op4_source_mixing,
        op5_quality_classifier,
        op6_url_filter,
        op7_substring_dedup,
        op8_sentencepiece,
        op9_chat_format,
        op10_ngram_join,
        op11_filter_audit,
        op12_token_alignment,
        op13_simhash,
    )
}

ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op4_source_mixing": OP4_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op9_chat_format": OP9_SQL,
    "op10_ngram_join": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
}
