"""Plans of the reading-corpus library."""
