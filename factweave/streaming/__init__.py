"""Structured Streaming forms of the ingest and of the probe state machine."""
