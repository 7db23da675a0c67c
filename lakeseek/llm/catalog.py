"""Queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from lakeseek.llm import audit, chat, decontaminate, fingerprints, langid, pieces, pii, secrets, sharding, simhash, spelling, suffixes, urls

QUERIES = {
    "op1_fingerprints": fingerprints.query,
    "op2_language_id": langid.query,
    "op3_decontamination": decontaminate.query,
    "op4_url_filters": urls.query,
    "op5_suffix_dedup": suffixes.query_with_text,
    "op6_sentencepiece": pieces.query,
    "op7_simhash": simhash.query,
    "op8_sharding": sharding.query,
    "op9_secrets": secrets.query,
    "op10_pii": pii.query,
    "op11_spelling_variants": spelling.query,
    "op12_filter_audit": audit.query,
    "op13_chat_formatting": chat.query,
}

ORACLES = {
    "op4_url_filters": urls.ORACLE,
    "op12_filter_audit": audit.ORACLE,
    "op13_chat_formatting": chat.ORACLE,
}
