"""Parquet readers and stand-in inputs (tables) and file sources/sinks (files)."""
