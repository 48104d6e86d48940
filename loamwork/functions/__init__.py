"""Scalar functions over names."""
