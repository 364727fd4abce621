"""Functions of the caption-corpus library."""
