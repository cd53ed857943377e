"""Operators of a training-data pipeline; nothing outside this subpackage imports them."""

from __future__ import annotations

from . import chat, classifier, decontam, html, pack, quality, shard, simhash, suffix, trie, urls, warc

OPERATORS = (
    html.op1_html_extraction,
    urls.op2_url_filters,
    suffix.op3_suffix_array_dedup,
    chat.op4_chat_formatting,
    quality.op5_quality_rules,
    simhash.op6_simhash_dedup,
    decontam.op7_benchmark_decontamination,
    pack.op8_best_fit_packing,
    shard.op9_sharding,
    classifier.op10_quality_classifier,
    warc.op11_warc,
    trie.op12_prefix_trie,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": urls.OP2_SQL,
        "op3_suffix_array_dedup": suffix.OP3_SQL,
        "op4_chat_formatting": chat.OP4_SQL,
        "op9_sharding": shard.OP9_SQL,
        "op11_warc": warc.OP11_SQL,
        "op12_prefix_trie": trie.OP12_SQL,
    }
