"""Incremental form of resumable scoring."""
