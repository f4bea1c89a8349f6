"""Structured Streaming: batch-fitted tables applied to arriving rows."""
