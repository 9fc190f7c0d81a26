"""Operators for building training corpora at scale; nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import bpe, compact_windows, cover_tree, decontamination, exact_dedup, html_extract, jaccard_join, language_id, line_dedup, phrase_mining, pii, token_alignment, token_counts

MODULES = (bpe, compact_windows, cover_tree, decontamination, exact_dedup, html_extract, jaccard_join, language_id, line_dedup, phrase_mining, pii, token_alignment, token_counts)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
