"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from . import bpe, covertree, decontam, licenses, lines, negatives, pii, quality, secrets, sharding, simhash, trie, urls

QUERIES = {
    "op1_lines": lines.op1_lines,
    "op2_secrets": secrets.op2_secrets,
    "op3_urls": urls.op3_urls,
    "op4_bpe": bpe.op4_bpe,
    "op5_ordinal": quality.op5_ordinal,
    "op6_covertree": covertree.op6_covertree,
    "op7_licenses": licenses.op7_licenses,
    "op8_simhash": simhash.op8_simhash,
    "op9_hilbert": sharding.op9_hilbert,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_trie": trie.op11_trie,
    "op12_negatives": negatives.op12_negatives,
    "op13_pii": pii.op13_pii,
}

ORACLE_SQL = {
    "op1_lines": lines.OP1_SQL,
    "op3_urls": urls.OP3_SQL,
    "op6_covertree": covertree.OP6_SQL,
    "op10_decontamination": decontam.OP10_SQL,
    "op11_trie": trie.OP11_SQL,
    "op12_negatives": negatives.OP12_SQL,
}
