"""Structured Streaming forms: ordered emission and running counts."""
