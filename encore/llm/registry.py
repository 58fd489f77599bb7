"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from encore.llm import bpe_count, chat, decontaminate, mixing, neardup, pii, quality, search, token_files, warc

QUERIES = {"op3_search": search.op3_search, "op5_near_duplicates": neardup.op5_near_duplicates, "op1_decontaminate": decontaminate.op1_decontaminate, "op6_quality": quality.op6_quality, "op2_token_files": token_files.op2_token_files, "op4_token_counts": bpe_count.op4_token_counts, "op7_mixing": mixing.op7_mixing, "op8_warc": warc.op8_warc, "op9_pii": pii.op9_pii, "op10_chat": chat.op10_chat}
ORACLES = {"op7_mixing": mixing.ORACLE, "op8_warc": warc.ORACLE, "op10_chat": chat.ORACLE}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
