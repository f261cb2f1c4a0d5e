"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from logloom.llm import bpe, chat, embeddings, hmm, html, langid, minhash, mixing, passages, rules, trie, urls, whitening

QUERIES = {
    "op1_near_dedup": minhash.op1_near_dedup,
    "op2_embedding_dedup": embeddings.op2_embedding_dedup,
    "op3_url_reputation": urls.op3_url_reputation,
    "op4_hmm_score": hmm.op4_hmm_score,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_chat_format": chat.op6_chat_format,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op10_html_extract": html.op10_html_extract,
    "op8_passage_dedup": passages.op8_passage_dedup,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op11_whitening": whitening.op11_whitening,
    "op12_language_id": langid.op12_language_id,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_near_dedup": minhash.OP1_SQL,
    "op2_embedding_dedup": embeddings.OP2_SQL,
    "op3_url_reputation": urls.OP3_SQL,
    "op5_quality_rules": rules.OP5_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
