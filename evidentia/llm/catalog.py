"""Collects the queries of this package."""

from __future__ import annotations

from importlib import import_module

from .base import ORACLES, QUERIES

MODULES = [
    "quality_rules",
    "language_id",
    "sentencepiece_codec",
    "html_extraction",
    "decontamination",
    "quality_classifier",
    "jaccard_join",
    "substring_dedup",
    "url_filters",
    "token_counts",
    "lexical_search",
    "merkle_manifest",
    "simhash_join",
]
for _name in MODULES:
    import_module(f"{__package__}.{_name}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
