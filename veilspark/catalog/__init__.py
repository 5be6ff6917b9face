"""Registered queries: each a Spark query over the given tables and, where SQL can say
the same, its twin for DuckDB."""
