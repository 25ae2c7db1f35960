"""All queries of the engine's own operators, by name."""

from __future__ import annotations

from docgraph.plans import code_queries, graph_queries, search_queries, store_queries, structure_queries, text_queries, upkeep_queries

ALL = {**text_queries.QUERIES, **search_queries.QUERIES, **graph_queries.QUERIES, **upkeep_queries.QUERIES, **store_queries.QUERIES, **structure_queries.QUERIES, **code_queries.QUERIES}
QUERIES = {name: fn for name, (fn, _) in ALL.items()}
ORACLES = {name: sql for name, (_, sql) in ALL.items() if sql}
