"""Incremental refresh of published snapshots."""
