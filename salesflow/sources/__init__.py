"""Readers, parsers, layer tables and generators."""
