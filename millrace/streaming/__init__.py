"""Structured Streaming forms of the window pipeline and its sink."""
