"""Merges over streams."""
