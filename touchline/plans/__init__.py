"""Whole jobs and queries composed from the operators."""
