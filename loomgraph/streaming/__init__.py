"""Structured Streaming forms of log ingestion and change triggers."""
