"""Structured Streaming forms of the document sink."""
