"""Streaming forms of the load steps."""
