"""The queries of this package, and their SQL."""

from importlib import import_module

MODULES = ("leakage_queries", "mixing_queries", "quality_queries", "nearduplicate_queries", "encoding_queries", "canonical_queries", "personal_queries")

QUERIES, ORACLE = {}, {}
for _m in MODULES:
    _module = import_module(f"shelfmark.llm.{_m}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
