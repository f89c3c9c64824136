"""Typed ingestion, data quality, change management and audit for CSV exports on Spark."""
