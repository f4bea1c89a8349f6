"""Registered queries with their DuckDB oracle SQL (q_*), the registry, and
the end-to-end recipes."""
