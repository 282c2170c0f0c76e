"""Streams over a repository's append-only logs."""
