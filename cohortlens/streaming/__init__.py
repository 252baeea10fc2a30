"""Structured Streaming: batch scoring is row-local, so it runs on streams as it is."""
