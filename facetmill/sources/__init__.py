"""Corpus insight: sources."""
