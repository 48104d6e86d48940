"""What a merge does, worked out before it runs."""
