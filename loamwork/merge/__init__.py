"""Merges driven by configurations."""
