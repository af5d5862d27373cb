"""Structured Streaming queries and their sinks."""
