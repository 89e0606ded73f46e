"""Structured Streaming forms of the minute-bar operators."""
