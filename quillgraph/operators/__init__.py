"""Reads, aggregates, graph, text search, constraints, mutations, changes and statistics."""
