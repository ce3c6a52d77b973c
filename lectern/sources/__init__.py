"""Sources of the reading-corpus library."""
