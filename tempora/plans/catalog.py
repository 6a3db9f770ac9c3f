"""All queries of the library and the SQL that gives the same rows."""

from importlib import import_module

MODULES = ["inference_queries", "event_queries", "similarity_queries", "model_queries", "report_queries", "chain_queries", "nested_queries", "source_queries"]

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"tempora.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
