"""Composed jobs: load, preview, retention."""
