"""Structured Streaming versions of the nightly and per-edit jobs."""
