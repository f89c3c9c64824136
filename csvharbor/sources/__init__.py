"""Readers: CSV records, headers, and the published table store."""
