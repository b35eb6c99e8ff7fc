"""Structured Streaming ingestion (an extension: the batch operators on a stream of files)."""
