"""Operators over arriving data, by Structured Streaming."""
