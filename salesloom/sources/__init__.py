"""Scans, ingest, connectors and the table layout."""
