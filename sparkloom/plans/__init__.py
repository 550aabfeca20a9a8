"""Queries over the fixed tables, with their SQL."""
