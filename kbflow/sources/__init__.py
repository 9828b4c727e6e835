"""Readers of the corpora, flattened into tables."""
