"""The thin queries over the training-data operators, and their oracles."""

from __future__ import annotations

from martlens.llm import chat, hosts, lines, neardup, negatives, vectors
from martlens.llm.alignment import op12_token_alignment
from martlens.llm.chat import op8_chat
from martlens.llm.fingerprint import op3_fingerprint
from martlens.llm.hosts import op13_url_filters
from martlens.llm.langid import op6_language_id
from martlens.llm.licenses import op10_licenses
from martlens.llm.lines import op9_line_dedup
from martlens.llm.mixing import op1_mix
from martlens.llm.neardup import op4_near_duplicates
from martlens.llm.negatives import op11_hard_negatives
from martlens.llm.pieces import op2_pieces
from martlens.llm.tokencount import op5_token_counts
from martlens.llm.vectors import op7_top_k

QUERIES = {
    "op1_mix": op1_mix,
    "op2_pieces": op2_pieces,
    "op3_fingerprint": op3_fingerprint,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_top_k": op7_top_k,
    "op8_chat": op8_chat,
    "op9_line_dedup": op9_line_dedup,
    "op10_licenses": op10_licenses,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_alignment": op12_token_alignment,
    "op13_url_filters": op13_url_filters,
}


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_near_duplicates": neardup.ORACLE, "op7_top_k": vectors.ORACLE, "op8_chat": chat.oracle(), "op9_line_dedup": lines.oracle(),
        "op11_hard_negatives": negatives.ORACLE, "op13_url_filters": hosts.oracle(),
    }
