"""Structured Streaming forms of the monitoring rules."""
