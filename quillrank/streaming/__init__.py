"""Structured Streaming jobs: ingest with deletes, counters, city match."""
