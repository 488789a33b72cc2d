"""Structured Streaming jobs: run records, running metrics and frame ingest."""
