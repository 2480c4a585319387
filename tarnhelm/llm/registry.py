"""Queries of this folder, one per operator, and their reference SQL."""

from __future__ import annotations

from tarnhelm.llm import (
    alignment,
    chat,
    decontamination,
    fingerprints,
    html,
    jaccard,
    language,
    licenses,
    mixing,
    neighbours,
    packing,
    phrases,
    tokens,
)

QUERIES = {
    "op1_html": html.op1_html,
    "op2_tokens": tokens.op2_tokens,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_packing": packing.op4_packing,
    "op5_chat": chat.op5_chat,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_mixing": mixing.op7_mixing,
    "op8_licenses": licenses.op8_licenses,
    "op9_language": language.op9_language,
    "op10_neighbours": neighbours.op10_neighbours,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_phrases": phrases.op12_phrases,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES = {
    "op5_chat": chat.ORACLE,
    "op6_jaccard": jaccard.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op11_decontamination": decontamination.ORACLE,
    "op12_phrases": phrases.ORACLE,
}
