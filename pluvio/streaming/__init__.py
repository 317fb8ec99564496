"""Structured Streaming forms of the polling operators."""
