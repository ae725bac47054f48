"""Incremental runs on Structured Streaming whose results equal the batch computation."""
