"""Corpus insight: streaming."""
