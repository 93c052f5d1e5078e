"""Queries: operators applied to the given tables, with their oracles."""
