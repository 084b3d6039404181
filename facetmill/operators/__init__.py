"""Corpus insight: operators."""
