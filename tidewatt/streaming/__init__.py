"""Structured Streaming ingest, and a bounded single writer."""
