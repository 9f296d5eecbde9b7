"""Incremental ingestion of model outputs with Structured Streaming."""
