"""The queries of the library by name, and the same in DuckDB's SQL."""

from plumbline.plans import oracles, queries, record_queries, structure_queries

QUERIES = queries.QUERIES | structure_queries.QUERIES | record_queries.QUERIES
ORACLES = oracles.ORACLES | structure_queries.ORACLES | record_queries.ORACLES
