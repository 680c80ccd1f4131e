"""Incremental ingest of landed files."""
