"""Queries over the given tables, one per operation, and their check SQL."""
