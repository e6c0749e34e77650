"""All queries over the reference's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from corpusflow.plans import pages, questions, refreshes

MODULES = (pages, refreshes, questions)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
