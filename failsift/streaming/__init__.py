"""Structured Streaming forms of the triage flow and the retry budget."""
