"""Readers, table scans, searches, ingestion and sinks."""
