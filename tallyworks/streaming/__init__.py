"""Incremental ingestion and stateful operators."""
