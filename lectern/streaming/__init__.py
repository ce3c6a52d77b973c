"""Streaming of the reading-corpus library."""
