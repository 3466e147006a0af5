"""Structured Streaming and incremental batch jobs."""
