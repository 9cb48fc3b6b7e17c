"""Structured Streaming forms of batch operators (the reference has no streams)."""
