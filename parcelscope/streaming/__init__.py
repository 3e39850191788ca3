"""Continuous jobs as Structured Streaming."""
