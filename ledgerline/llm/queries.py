"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgerline.llm import conversation_trie, decontaminate, exact_dedup, filter_audit, language_id, mixing, ngram_join, pseudonyms, secret_scan, sharding, token_counts, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1,
        "op2_ngram_join": ngram_join.op2,
        "op3_sharding": sharding.op3,
        "op4_exact_dedup": exact_dedup.op4,
        "op5_mixing": mixing.op5,
        "op6_decontamination": decontaminate.op6,
        "op7_url_filter": url_filter.op7,
        "op8_toxicity": toxicity.op8,
        "op9_pseudonyms": pseudonyms.op9,
        "op10_language_id": language_id.op10,
        "op11_conversation_trie": conversation_trie.op11,
        "op12_secret_scan": secret_scan.op12,
        "op13_filter_audit": filter_audit.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": sharding.SQL, "op4_exact_dedup": exact_dedup.SQL, "op5_mixing": mixing.SQL, "op6_decontamination": decontaminate.SQL, "op7_url_filter": url_filter.SQL, "op11_conversation_trie": conversation_trie.SQL, "op12_secret_scan": secret_scan.SQL, "op13_filter_audit": filter_audit.SQL}
