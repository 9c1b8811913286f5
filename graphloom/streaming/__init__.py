"""Structured Streaming over the same filters and records as batch queries."""
