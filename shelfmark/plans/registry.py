"""All queries of the core, and their SQL."""

from importlib import import_module

MODULES = ("snapshot_queries", "text_queries", "plan_queries", "index_queries")

QUERIES, ORACLE = {}, {}
for _m in MODULES:
    _module = import_module(f"shelfmark.plans.{_m}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
