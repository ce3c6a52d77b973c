"""Functions of the reading-corpus library."""
