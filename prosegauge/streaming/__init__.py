"""Structured Streaming forms of the collector."""
