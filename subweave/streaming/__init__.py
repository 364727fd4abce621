"""Streaming of the caption-corpus library."""
