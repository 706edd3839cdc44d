"""Structured Streaming versions of the audit."""
