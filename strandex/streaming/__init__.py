"""Structured Streaming forms of the query caches and of substring counts."""
