"""Composed jobs: the freight view of the test tables, the full audit, the query registry."""
