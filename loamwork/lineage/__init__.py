"""Lineage from definitions to closures and reports."""
