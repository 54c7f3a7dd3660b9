"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pulseloom.llm import bpe, chat, decontam, lexical, licenses, minhash, pii, quality, repeats, sharding, urls, whitening, wrappers

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_urls": urls.op2_urls,
    "op3_bpe": bpe.op3_bpe,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_sharding": sharding.op5_sharding,
    "op6_minhash": minhash.op6_minhash,
    "op7_pii": pii.op7_pii,
    "op8_repeats": repeats.op8_repeats,
    "op9_chat": chat.op9_chat,
    "op10_quality": quality.op10_quality,
    "op11_html": wrappers.op11_html,
    "op12_whitening": whitening.op12_whitening,
    "op13_search": lexical.op13_search,
}

# The others are held against brute force in the tests: no SQL can fit trees, merge tokens or hash as Spark does.
ORACLE = {
    "op1_licenses": licenses.SQL,
    "op2_urls": urls.SQL,
    "op5_sharding": sharding.SQL,
    "op6_minhash": minhash.SQL,
    "op8_repeats": repeats.SQL,
    "op9_chat": chat.SQL,
    "op13_search": lexical.SQL,
}
