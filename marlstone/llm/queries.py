"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from marlstone.llm import bpe, chat, decontaminate, html_extract, language_id, line_dedup, near_dedup, pii, quality, token_files

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_bpe": bpe.op2_bpe,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_html": html_extract.op4_html,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_chat": chat.op7_chat,
    "op8_quality": quality.op8_quality,
    "op9_pii": pii.op9_pii,
    "op10_language_id": language_id.op10_language_id,
}

ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
    "op7_chat": chat.ORACLE,
    "op8_quality": quality.ORACLE,
}
