"""The registered queries with their SQL, over the test tables."""

from . import functions, graph, history, joins, languages, logs, readers, registry, relational, streams, text, trends, work  # noqa: F401

queries, oracle_sql = registry.queries, registry.oracle_sql
