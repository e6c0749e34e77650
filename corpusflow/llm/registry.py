"""All queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from corpusflow.llm import ann, language, licenses, mixing, near_dedup, packing, repeats, sharding, token_counts, topk

MODULES = (topk, sharding, mixing, near_dedup, token_counts, ann, repeats, packing, licenses, language)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
