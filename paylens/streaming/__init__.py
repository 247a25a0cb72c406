"""Incremental loading of JSON drops."""
