"""Monitoring: append-only evaluation history and its Structured Streaming form."""
