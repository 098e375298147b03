"""Ingest in batches and micro-batches."""
