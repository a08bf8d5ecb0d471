"""Operators for large training-text tables."""
