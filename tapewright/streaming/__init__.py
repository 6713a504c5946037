"""Incremental ingest and scans with Structured Streaming."""
