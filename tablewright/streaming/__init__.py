"""Structured Streaming front end of the batch plan."""
