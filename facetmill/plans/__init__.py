"""Corpus insight: plans."""
