"""Structured Streaming forms of windowed operators."""
