"""Incremental assembly on Structured Streaming."""
