"""Structured Streaming forms of the change feed and of windowed counts."""
