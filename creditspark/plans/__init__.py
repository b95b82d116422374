"""Registered queries (Spark plan builders) and their DuckDB oracle SQL."""
