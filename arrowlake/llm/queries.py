"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, conversations, fingerprints, html_extract, language_id, merkle, mixing, ngram_join, packing, quality, secret_scan, suffix_dedup, topk_search

QUERIES = {
    "op1_topk": topk_search.op1_topk,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_language_id": language_id.op3_language_id,
    "op4_fingerprint": fingerprints.op4_fingerprint,
    "op5_packing": packing.op5_packing,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLE_SQL = {
    "op1_topk": topk_search.OP1_SQL,
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op4_fingerprint": fingerprints.OP4_SQL,
    "op6_secret_scan": secret_scan.OP6_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
}
