"""Incremental index maintenance on Structured Streaming."""
