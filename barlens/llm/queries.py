"""Queries of the text operators, and their SQL where SQL can express the result."""

from __future__ import annotations

from barlens.llm import (bpe, chat, conversation_repair, decontaminate, fim, licenses, line_dedup, near_dedup, packing, pii,
                         quality, secrets, toxicity)

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_licenses": licenses.op4_licenses,
    "op5_pii": pii.op5_pii,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_packing": packing.op11_packing,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op3_chat_formatting": chat.OP3_SQL,
    "op6_decontamination": decontaminate.OP6_SQL,
    "op7_near_dedup": near_dedup.OP7_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}
