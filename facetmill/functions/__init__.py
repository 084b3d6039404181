"""Corpus insight: functions."""
