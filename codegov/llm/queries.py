"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: In the order of the operators' numbers.
MODULES = ("near_vectors", "html_text", "line_dedup", "search", "toxicity", "ngram_join", "byte_bpe", "token_counts", "quality", "packing", "word_runs", "manifest", "language_id")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
