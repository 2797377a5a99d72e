"""Incremental maps with Structured Streaming."""
