"""Structured Streaming jobs over drop directories and logs."""
