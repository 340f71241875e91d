"""Readers and writers for snapshots."""
