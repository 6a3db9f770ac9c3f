"""Operators for large training corpora; nothing else in the library imports them."""

from importlib import import_module

MODULES = ["chat_format", "line_dedup", "minhash_dedup", "packing", "pii", "toxicity", "url_filter", "decontaminate", "license_scan", "exact_dedup", "ball_search", "periodic_runs", "suffix_dedup"]


def registered(what: str) -> dict:
    """All ``QUERIES`` or ``ORACLE_SQL`` of the modules above."""
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), what).items()}
