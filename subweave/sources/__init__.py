"""Sources of the caption-corpus library."""
