"""Structured Streaming wrappers, an extra beside the batch plans."""
