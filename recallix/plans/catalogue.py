"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from recallix.plans import extraction, general, graph, knowledge, memory, retrieval, state, stream, text

FLAGSHIP = "p1_found"
MODULES = (general, graph, knowledge, text, retrieval, memory, state, stream, extraction)

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
