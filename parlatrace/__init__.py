"""Spark operators for time-aligned speech transcripts and their documents."""

__version__ = "0.1.0"
