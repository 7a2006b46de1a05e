"""Operators over Structured Streaming sources."""
