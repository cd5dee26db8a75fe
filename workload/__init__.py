"""Queries over the given tables, with SQL to check them by."""
