"""Structured Streaming: periodic ingest and upserts."""
