"""Structured Streaming over the append-only quote table."""
