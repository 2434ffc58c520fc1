"""Incremental counts of arriving works, with Structured Streaming."""
