"""Test-table mappings, the query registry and its independent SQL."""
