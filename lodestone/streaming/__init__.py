"""Structured Streaming pieces."""
