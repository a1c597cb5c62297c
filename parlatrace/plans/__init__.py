"""Queries over the test tables, with SQL of the same meaning."""
