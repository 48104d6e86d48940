"""Operators over tables: dimensions, profiles, data checks."""
