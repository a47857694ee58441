"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from tidewright.llm import chat, embed, huffman, minhash, mixing, packing, quality, rules, secrets, urls

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_url_filters": urls.op4_url_filters,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_packing": packing.op6_packing,
    "op7_embedding_dedup": embed.op7_embedding_dedup,
    "op8_minhash_dedup": minhash.op8_minhash_dedup,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_token_output": huffman.op10_token_output,
}
SQL = {
    "op1_chat_formatting": chat.SQL,
    "op4_url_filters": urls.SQL,
    "op5_source_mixing": mixing.SQL,
    "op9_quality_rules": rules.SQL,
}
