"""All queries over the test tables, by name, with DuckDB SQL to hold them against."""

from __future__ import annotations

from . import data_queries, graph_queries, value_queries

FLAGSHIP = "critical_path_total"
QUERIES: dict = graph_queries.QUERIES | data_queries.QUERIES | value_queries.QUERIES
ORACLES: dict[str, str] = graph_queries.ORACLES | data_queries.ORACLES | value_queries.ORACLES
