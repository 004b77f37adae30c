"""Structured Streaming forms of the ingest and health operators."""
