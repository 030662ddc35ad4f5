"""Structured Streaming versions of the one-pass sketch and column norms."""
