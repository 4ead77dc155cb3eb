"""Incremental ingest, batch and Structured Streaming."""
