"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["decontaminate", "token_files", "language_model", "mixing", "chat", "url_rules", "quality", "spotsigs", "language", "shingle_join", "hard_negatives", "merkle", "packing"]


def _all(attribute: str) -> dict:
    return {name: x for module in MODULES for name, x in getattr(import_module(f"echotrace.llm.{module}"), attribute).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
