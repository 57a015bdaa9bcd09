"""Span-label analytics and text processing on PySpark."""

__version__ = "0.1.0"
