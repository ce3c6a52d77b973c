"""Operators of the reading-corpus library."""
