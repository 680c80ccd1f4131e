"""Readers for landed files and tables."""
