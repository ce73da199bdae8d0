"""Structured Streaming forms of the event-driven steps."""
