"""Plans of the caption-corpus library."""
