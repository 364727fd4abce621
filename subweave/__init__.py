"""Spark jobs for large collections of caption tracks."""
