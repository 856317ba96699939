"""Streaming forms of the append-only feeds."""
