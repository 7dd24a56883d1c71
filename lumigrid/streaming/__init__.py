"""Structured Streaming forms of the event and log jobs."""
