"""Structured Streaming wrappers of batch jobs."""
