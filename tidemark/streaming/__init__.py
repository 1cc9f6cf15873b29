"""Structured Streaming over logs: tailing and replication."""
