"""Registered queries, each with its SQL equivalent where one exists."""
