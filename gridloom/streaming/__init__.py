"""Structured Streaming forms of the event rules."""
