"""Queries that arrive as a stream, scored against a fixed index."""
