"""Operators of the caption-corpus library."""
