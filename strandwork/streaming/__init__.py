"""Structured Streaming over sequence files."""
