"""All queries of the engine, and the SQL of those that SQL can express."""

from . import kernel_queries, model_queries, source_queries, window_queries

QUERIES = window_queries.QUERIES | model_queries.QUERIES | kernel_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = window_queries.ORACLE_SQL | model_queries.ORACLE_SQL | kernel_queries.ORACLE_SQL | source_queries.ORACLE_SQL
FLAGSHIP = window_queries.window_signal_stats
