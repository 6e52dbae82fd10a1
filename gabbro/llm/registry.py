"""Queries of the corpus operators, one opN_<name> for each, and the SQL of those that SQL can express."""

from __future__ import annotations

from gabbro.llm import (
    bpe_automaton, chat_format, compression_rules, filter_interactions, mixture, mtree, ngram_join, quality_gbdt, source_divergence, subword_toxicity, suffix_dedup,
    url_filters, warc_zip,
)

QUERIES = {}
ORACLE_SQL = {}

for _m in (chat_format, compression_rules, bpe_automaton, mtree, warc_zip, quality_gbdt, mixture, url_filters, ngram_join, suffix_dedup, subword_toxicity, source_divergence, filter_interactions):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= getattr(_m, "ORACLE_SQL", {})
