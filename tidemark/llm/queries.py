"""The queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import chat_format, decontaminate, embedding_join, html_text, language_id, line_dedup, piece_encoding, shingle_join, toxicity, warc

QUERIES = {
    "op1_embedding_join": embedding_join.op1_embedding_join,
    "op2_shingle_join": shingle_join.op2_shingle_join,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_warc": warc.op5_warc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_html_text": html_text.op9_html_text,
    "op10_piece_encoding": piece_encoding.op10_piece_encoding,
}

ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_warc": warc.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
}
